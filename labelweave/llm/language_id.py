"""Language identification by fusing evidence the Bayesian way.

log P(l | row) = text likelihood + log P(declared | l) + log P(suffix | l) + log P(l | host) + const. A text that no
known language makes much likelier than letters at random is in another one. The text
likelihood is naive Bayes over hashed byte trigrams. What markup and address say is weighed by how it agrees with the
texts of the whole corpus; the prior of a host is its own counts smoothed by its domain's, those by the corpus's. All
these tables come from one grouped aggregation of the texts' posteriors.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.common import free_name, kept_columns, quoted, staged

LANGUAGES = ("de", "en", "es", "fr")
BUCKET_BITS = 14
#: The language of texts that are in none of those known.
OTHER = "other"
#: Share of unknown trigrams that a known language is granted; how much likelier than at random it must make a trigram of a text, in nats; how much less per deviation of a short text.
UNKNOWN_SHARE, LEAST_RATIO, SHORT_SLACK = 0.1, 0.5, 1.5
LETTER, LETTERS = r"\p{L}", re.compile(r"[^\W\d_]+")
#: Tables of up to so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 50_000


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all byte trigrams of the lower-cased texts, each text between spaces, and where each text begins."""
    parts = [f"  {t.lower()} ".encode() for t in texts]
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)
    starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    return code, starts


def _slices(texts: list[str | None], size: int = 1 << 19):
    """Texts in runs of about `size` characters; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n > size:
            yield run
            run, n = [], 0
    if run:
        yield run


def fit_text_model(df: DataFrame, text: str, label: Column, languages: tuple[str, ...], fit_rows: int) -> tuple[np.ndarray, Column]:
    """log P(bucket | language), a row for each bucket, from about fit_rows labelled rows chosen by a hash of the text; and which rows these are."""
    known = df.select(quoted(text).cast("string").alias("t"), label.alias("l")).where(F.col("l").isin(*languages) & F.col("t").rlike(LETTER))
    n = known.count()
    chosen = lambda t: t.rlike(LETTER) & (F.pmod(F.xxhash64(t, F.lit(5)), F.lit(max(1, n // fit_rows))) == 0)
    known = known.where(chosen(F.col("t")))

    def count(batches):
        sums = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            of = {x: i for i, x in enumerate(languages)}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[of[x]] += np.bincount(_grams([t])[0], minlength=1 << BUCKET_BITS)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[which, bucket], pa.int64())], ["l", "b", "n"])

    table = known.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    counts[table["b"], table["l"]] += table["n"]
    return np.log(counts / counts.sum(0)).astype(np.float32), F.coalesce(chosen(quoted(text).cast("string")), F.lit(False))


def likeness(model: np.ndarray) -> np.ndarray:
    """How much likelier each language makes a bucket than at random, in nats, if it grants some room to what it hasn't shown."""
    return np.log((1 - UNKNOWN_SHARE) * np.exp(model.astype(np.float64)) * len(model) + UNKNOWN_SHARE).astype(np.float32)


def log_odds_other(like: np.ndarray, run: list[str], cap: float) -> np.ndarray:
    """Log odds that each text is in none of the languages, by its words of letters: numbers and marks tell nothing. Without letters: none."""
    code, starts = _grams([" ".join(LETTERS.findall(t)) for t in run])
    sizes = np.diff(np.append(starts, len(code) + 2)) - 2  # the last two codes of each reach into the next text
    sums = np.add.reduceat(np.concatenate([like[code], np.zeros((2, like.shape[1]), np.float32)]), starts, axis=0).astype(np.float64)
    ratio = (sums / np.maximum(1, sizes)[:, None]).max(1)
    gap = LEAST_RATIO - SHORT_SLACK * np.sqrt(3 / np.maximum(1, sizes)) - ratio
    return np.where(sizes > 1, gap * sizes / (1 + sizes / cap), -100.0)


def text_evidence(model: np.ndarray, text: Column, cap: float) -> Column:
    """Array of log likelihoods, one for each language, relative to the best, and at its end the log odds that it is none of them.

    All trigrams of a text count; as neighbours depend on one another their mean is taken n / (1 + n / cap) times. No
    letters: no evidence.
    """
    like = likeness(model)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(t: pa.Array) -> pa.Array:
        out = []
        for run in _slices(t.to_pylist()):
            code, starts = _grams(run)
            sums = np.add.reduceat(model[np.append(code, [0, 0])], starts, axis=0).astype(np.float64)  # the model's rows, by text
            sizes = np.diff(np.append(starts, len(code) + 2))
            weight = np.where([any(map(str.isalpha, x)) for x in run], 1 / (1 + sizes / cap), 0.0)
            part = sums * weight[:, None]
            out.append(np.column_stack([part - part.max(1, keepdims=True), log_odds_other(like, run, cap)]))
        flat = np.concatenate(out) if out else np.zeros((0, model.shape[1] + 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, model.shape[1] + 1), pa.int32()), pa.array(flat.ravel()))

    return score(text)


def _posterior(scores: Column, n: int) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def identify(
    df: DataFrame,
    text: str = "text",
    label: Column | None = None,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    fit_rows: int = 8000,
    cap: float = 60.0,
    strength: float = 20.0,
    least: float = 0.5,
    names: tuple[str, str, str] = ("lang_id", "lang_p", "lang_ok"),
) -> DataFrame:
    """Return df with its language, that language's posterior and whether it is accepted.

    label: a known language for some rows, of which about fit_rows (chosen by a hash) fit the text model; declared, suffix,
    host and domain: the other evidence, null where there is none. Without label the declared language labels, and counts
    no second time as evidence of the rows that the model was fitted on. A text that is in none of the languages is `other`, whatever
    else is said of it, and tells nothing of its host. A row is accepted if its text has a letter, it isn't `other` and its
    posterior is `least` or more. A null or empty text, or one without letters, has no text evidence: it gets what the
    rest says and isn't accepted. Whole texts count. Every row is kept, repeated rows alike; an empty table gives an
    empty result. Columns of df that have one of the names, in any case, are replaced. strength: how many rows a parent's
    prior weighs.
    """
    none = F.lit(None).cast("string")
    lang, p, ok = names
    d, s, h, dom, ev, of_d, of_s, of_h, post, top, odd, odds = (free_name(df, f"__{x}", *names) for x in ("declared", "suffix", "host", "domain", "evidence", "ofd", "ofs", "ofh", "post", "top", "odd", "odds"))
    model, fitted = fit_text_model(df, text, label if label is not None else declared, languages, fit_rows)
    known = F.lower(F.substring(F.trim(declared.cast("string")), 1, 2)) if declared is not None else none
    rows = df.withColumns({d: F.when(known.isin(*languages), known), s: (suffix if suffix is not None else none).cast("string"), h: (host if host is not None else none).cast("string"), dom: (domain if domain is not None else none).cast("string")})
    n = len(languages)
    rows = rows.withColumn(odds, text_evidence(model, quoted(text).cast("string"), cap))
    rows = rows.withColumns({ev: F.slice(odds, 1, n), odd: F.element_at(odds, n + 1)})

    # sums of the texts' posteriors for everything that is said beside the text: one aggregation, the base of all tables
    soft = F.when(F.col(odd) <= 0, _posterior(F.col(ev), n)).otherwise(F.array(*[F.lit(0.0)] * n))
    cells = staged(rows.withColumn(post, soft).groupBy(d, s, h, dom).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(post)[i]).alias(f"p{i}") for i in range(n)]), "language-cells")

    def table(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.array(*[F.sum(f"p{i}") for i in range(n)]).alias("c")) if by else cells.agg(F.array(*[F.coalesce(F.sum(f"p{i}"), F.lit(0.0)) for i in range(n)]).alias("c"))

    total = [x + 1.0 for x in table().first()[0]]
    share = [x / sum(total) for x in total]

    def likelihood(by: str, values: int) -> DataFrame:
        """log P(value | language), smoothed towards the value's share of all rows; a null says nothing."""
        t = table(by).where(F.col(by).isNotNull())
        every = F.aggregate("c", F.lit(0.0), lambda a, v: a + v)
        smooth = [F.log((F.col("c")[i] + strength * (every + 1) / F.lit(sum(total) + values)) / F.lit(total[i] + strength)) for i in range(n)]
        return t.select(by, F.array(*smooth).alias(of_d if by == d else of_s))

    def smoothed(c: Column, parent: Column) -> Column:
        every = F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
        return F.array(*[(c[i] + strength * parent[i]) / (every + strength) for i in range(n)])

    corpus = F.array(*[F.lit(x) for x in share])
    domains = table(dom).where(F.col(dom).isNotNull()).select(dom, smoothed(F.col("c"), corpus).alias("__dp"))
    hosts = table(h, dom).where(F.col(h).isNotNull()).join(domains, dom, "left")
    hosts = hosts.groupBy(h).agg(F.max(F.struct(F.size("c"), F.col("c"), F.coalesce("__dp", corpus).alias("dp"))).alias("x")) if domain is None else hosts.groupBy(h).agg(F.struct(F.lit(n), F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("c"), F.first(F.coalesce("__dp", corpus)).alias("dp")).alias("x"))
    hosts = hosts.select(h, F.transform(smoothed(F.col("x.c"), F.col("x.dp")), lambda x: F.log(x)).alias(of_h))

    zero = F.array(*[F.lit(0.0)] * n)
    if label is None:  # what a row said as a label it doesn't say again
        rows = rows.withColumn(d, F.when(~fitted, F.col(d)))
    for name, t in ((d, likelihood(d, n)), (s, likelihood(s, 100)), (h, hosts)):
        rows = rows.join(_sized(t), name, "left")
    log_corpus = F.array(*[F.lit(math.log(x)) for x in share])
    parts = [F.col(ev), F.coalesce(of_d, zero), F.coalesce(of_s, zero), F.coalesce(of_h, log_corpus)]
    sums = F.array(*[sum((x[i] for x in parts[1:]), parts[0][i]) for i in range(n)])
    rows = rows.withColumn(post, _posterior(sums, n)).withColumn(top, F.array_max(post))
    names_of = F.array(*[F.lit(x) for x in languages])
    lettered = F.coalesce(quoted(text).cast("string"), F.lit("")).rlike(LETTER)
    keep = kept_columns(df, names)
    other = F.col(odd) > 0
    found = F.when(other, OTHER).otherwise(F.element_at(names_of, F.array_position(post, F.col(top)).cast("int")))
    sure = F.when(other, 1 / (1 + F.exp(-F.col(odd)))).otherwise(F.col(top))
    return rows.select(*keep, found.alias(lang), F.round(sure, 6).alias(p), (lettered & ~other & (F.col(top) >= least)).alias(ok))


#: Markup that declares a page's language.
MARKUP_LANGUAGE = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2})"


def page_evidence(html: str = "html", url: str = "url") -> dict[str, Column]:
    """What a page's markup and address say: declared, suffix (with a language code that starts the path), host, domain."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    code = F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.concat(F.regexp_extract(host, r"([^.]+)$", 1), F.when(code != "", F.concat(F.lit("/"), code)).otherwise(""))
    empty = lambda c: F.when(c != "", c)
    return {"declared": empty(F.regexp_extract(html, MARKUP_LANGUAGE, 1)), "suffix": empty(suffix), "host": empty(host), "domain": empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))}


def page_text(html: str = "html") -> Column:
    """A page's text: scripts, styles, comments and tags taken out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[a-z#0-9]+;", " ")
