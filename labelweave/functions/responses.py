"""Answers of models as records: the first JSON object in a text, its schema, and the evidence that it cites."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = "label string, confidence double, rationale string, error string"
#: Lists in an answer whose entries are ids of evidence.
EVIDENCE_KEYS = ("evidence_edges", "evidence_ids")
#: Levels to which an answer may be nested, and objects that are nested too deep for the parser after which a text is given up.
MOST_DEPTH, MOST_DEEP = 64, 8


def depth(value) -> int:
    """Levels of lists and objects in a value."""
    deepest, level = 0, [value]
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)] if deepest else [value]:
        deepest += 1
    return deepest - 1


def first_object(text: str | None) -> dict | None:
    """The first JSON object that begins anywhere in a text, if that is whole and nested to MOST_DEPTH levels at most."""
    text, decoder, at, deep = text or "", json.JSONDecoder(), -1, 0
    while deep < MOST_DEEP and (at := text.find("{", at + 1)) >= 0:
        try:
            found = decoder.raw_decode(text, at)[0]
        except ValueError:
            continue
        except RecursionError:
            deep += 1
            continue
        return found if depth(found) <= MOST_DEPTH else None
    return None


def classification(text: str | None, labels: tuple[str, ...]) -> tuple:
    """(label, confidence, rationale, error) of an answer; an error leaves the others null."""
    answer = first_object(text)
    if answer is None:
        return None, None, None, "no object"
    label = {x.casefold(): x for x in labels}.get(str(answer.get("label", "")).strip().casefold())
    if label is None:
        return None, None, None, "unknown label"
    try:
        confidence = float(answer["confidence"])
    except (KeyError, TypeError, ValueError):
        confidence = math.nan
    if not 0 <= confidence <= 1:
        return None, None, None, "confidence"
    why = answer.get("rationale")
    if not isinstance(why, str) or not why.strip() or len(why) > 2000:
        return None, None, None, "rationale"
    return label, confidence, why.strip(), None


def references(value) -> set[str]:
    """Ids in the lists of evidence anywhere in a value."""
    if isinstance(value, dict):
        cited = [set(map(str, v)) if k in EVIDENCE_KEYS and isinstance(v, list) else references(v) for k, v in value.items()]
    else:
        cited = [references(v) for v in value] if isinstance(value, list) else []
    return set().union(*cited)


def parsed(labels: tuple[str, ...]):
    """A column function: text to a struct of PARSED."""

    @F.pandas_udf(PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classification(x, labels) for x in texts], columns=["label", "confidence", "rationale", "error"]).astype({"confidence": "float64"})

    return parse


@F.pandas_udf(T.ArrayType(T.StringType()))
def cited(texts: pd.Series) -> pd.Series:
    """Sorted ids of the evidence that the first object of a text cites."""
    return pd.Series([sorted(references(first_object(x))) for x in texts])


def problems(verdicts: tuple[str, ...], stages: tuple[str, ...], required: tuple[str, ...], lists: tuple[str, ...]):
    """A column function: text and valid ids to the list of what is wrong with an answer."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series, valid: pd.Series) -> pd.Series:
        out = []
        for text, ids in zip(texts, valid):
            answer = first_object(text) or {}
            confidence, found = answer.get("confidence"), references(answer)
            faults = [f"missing {k}" for k in sorted(set(required) - answer.keys())]
            faults += ["verdict"] * (answer.get("verdict") not in verdicts) + ["stage"] * (answer.get("stage") not in stages)
            faults += ["confidence"] * (not (isinstance(confidence, (int, float)) and 0 <= confidence <= 1))
            faults += ["review"] * (not isinstance(answer.get("needs_analyst_review"), bool))
            faults += [f"list {k}" for k in lists if not isinstance(answer.get(k), list)]
            faults += [f"evidence {k}" for k in sorted(found - set(ids if ids is not None else ()))]
            faults += ["no evidence"] * (answer.get("verdict") == "malicious" and not found)
            out.append(faults)
        return pd.Series(out)

    return check
