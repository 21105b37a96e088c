import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelweave.llm import queries as Q
from labelweave.llm.language_id import BUCKET_BITS, LANGUAGES, LETTERS, identify

#: One passage, told in languages that the corpus has and in others.
KNOWN = {
    "en": "The next morning the old fisherman left his house before dawn and walked along the deserted beach, watching the waves that broke on the rocks. He had not slept much but felt calm and ready for the day's work.",
    "es": "A la mañana siguiente el viejo pescador salió de casa antes del amanecer y caminó por la playa desierta, mirando las olas que rompían en las rocas. No había dormido mucho, pero se sentía tranquilo y listo para el trabajo del día.",
    "de": "Am nächsten Morgen verließ der alte Fischer vor Sonnenaufgang sein Haus und ging den verlassenen Strand entlang und sah den Wellen zu, die an den Felsen brachen. Er hatte nicht viel geschlafen, fühlte sich aber ruhig und bereit für die Arbeit des Tages.",
    "fr": "Le lendemain matin, le vieux pêcheur quitta sa maison avant l'aube et marcha le long de la plage déserte, regardant les vagues qui se brisaient sur les rochers. Il n'avait pas beaucoup dormi mais se sentait calme et prêt pour le travail de la journée.",
}
FOREIGN = {
    "it": "La mattina seguente il vecchio pescatore uscì di casa prima dell'alba e camminò lungo la spiaggia deserta, guardando le onde che si rompevano sugli scogli. Non aveva dormito molto, ma si sentiva tranquillo e pronto per il lavoro della giornata.",
    "pt": "Na manhã seguinte o velho pescador saiu de casa antes do amanhecer e caminhou pela praia deserta, olhando as ondas que quebravam nas rochas. Não tinha dormido muito, mas sentia-se tranquilo e pronto para o trabalho do dia.",
    "nl": "De volgende ochtend verliet de oude visser voor zonsopgang zijn huis en liep langs het verlaten strand, kijkend naar de golven die op de rotsen braken. Hij had niet veel geslapen, maar voelde zich rustig en klaar voor het werk van die dag.",
    "zh": "第二天早晨，老渔夫在天亮之前离开了家，沿着荒凉的海滩走着，看着海浪拍打在岩石上。他睡得不多，但感到平静，准备好迎接一天的工作。",
    "ru": "На следующее утро старый рыбак вышел из дома до рассвета и пошёл по пустынному берегу, глядя на волны, разбивавшиеся о скалы. Он мало спал, но чувствовал себя спокойно и был готов к дневной работе.",
    "sv": "Nästa morgon lämnade den gamle fiskaren sitt hem före gryningen och gick längs den öde stranden och såg på vågorna som bröts mot klipporna.",
    "ja": "翌朝、老いた漁師は夜明け前に家を出て、人けのない浜辺を歩きながら、岩に砕ける波を眺めていた。",
}
SF = "/root/testdata/sf0.01"


def with_foreign(spark):
    docs = Q.documents(spark, SF)
    rows = [(10**6 + i, t, None, "src1", len(t)) for i, t in enumerate([*FOREIGN.values(), *KNOWN.values()])]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(k) for c, k in docs.dtypes]))


def test_foreign_texts_are_other_and_known_ones_are_not(spark):
    got = {r["doc_id"]: r for r in identify(with_foreign(spark), declared=F.col("lang"), host=F.col("source")).collect()}
    for i, name in enumerate(FOREIGN):
        r = got[10**6 + i]
        assert r["lang_id"] == "other" and not r["lang_ok"] and 0.5 < r["lang_p"] <= 1, name
    for i, name in enumerate(KNOWN, len(FOREIGN)):
        assert got[10**6 + i]["lang_id"] == name and got[10**6 + i]["lang_ok"], name
    own = [r for d, r in got.items() if d < 10**6 and r["text"] and LETTERS.search(r["text"])]
    assert sum(r["lang_id"] == "other" for r in own) <= len(own) / 500
    assert sum(r["lang_ok"] for r in own) >= 0.995 * len(own)


def test_first_stage_rejects_foreign_texts(spark):
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, with_foreign(spark), SF).select("doc_id").collect()}
    assert not {d for d in kept if 10**6 <= d < 10**6 + len(FOREIGN)} and {10**6 + len(FOREIGN) + i for i in range(len(KNOWN))} <= kept


def test_posteriors_are_those_of_a_plain_computation(spark):
    """All evidence but the address, worked out with dictionaries for every document."""
    docs = [r for r in Q.documents(spark, SF).select("doc_id", "text", "lang", "source").collect()]
    grams = lambda t: [((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B + b[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - BUCKET_BITS) for b in [f"  {t.lower()} ".encode()] for i in range(len(b) - 2)]
    size = 1 << BUCKET_BITS
    counts = {v: defaultdict(lambda: 0.5) for v in LANGUAGES}
    for r in docs:
        if r["lang"] in LANGUAGES and r["text"] and any(map(str.isalpha, r["text"])):
            for g in grams(r["text"]):
                counts[r["lang"]][g] += 1
    whole = {v: sum(c.values()) + 0.5 * (size - len(c)) for v, c in counts.items()}
    prob = lambda v, g: counts[v].get(g, 0.5) / whole[v]
    text, other = {}, {}
    for r in docs:
        t = r["text"] or ""
        g, w = grams(t), grams(" ".join(LETTERS.findall(t)))
        x = {v: sum(math.log(prob(v, k)) for k in g) / (1 + len(g) / 60) if any(map(str.isalpha, t)) else 0.0 for v in LANGUAGES}
        text[r["doc_id"]] = {v: y - max(x.values()) for v, y in x.items()}
        ratio = max(sum(math.log(0.9 * prob(v, k) * size + 0.1) for k in w) / max(1, len(w)) for v in LANGUAGES)
        other[r["doc_id"]] = len(w) > 1 and 0.5 - 1.5 * math.sqrt(3 / len(w)) > ratio

    def posterior(x):
        top = max(x.values())
        e = {v: math.exp(y - top) for v, y in x.items()}
        return {v: y / sum(e.values()) for v, y in e.items()}

    host, every = defaultdict(lambda: defaultdict(float)), {v: 1.0 for v in LANGUAGES}
    for r in docs:
        if not other[r["doc_id"]]:
            for v, p in posterior(text[r["doc_id"]]).items():
                host[r["source"]][v] += p
                every[v] += p
    share = {v: x / sum(every.values()) for v, x in every.items()}
    got = {r["doc_id"]: r for r in Q.op9_language_id(spark, SF).collect()}
    for r in docs:
        g = got[r["doc_id"]]
        if other[r["doc_id"]]:
            assert g["lang_id"] == "other" and not g["lang_ok"]
            continue
        h = host.get(r["source"]) if r["source"] is not None else None
        # the corpus is the parent of every host's domain-less prior
        prior = {v: (h[v] + 20 * share[v]) / (sum(h.values()) + 20) if h else share[v] for v in LANGUAGES}
        p = posterior({v: text[r["doc_id"]][v] + math.log(prior[v]) for v in LANGUAGES})
        best = max(p, key=p.get)
        if not any(map(str.isalpha, r["text"] or "")) and r["lang"] in LANGUAGES:
            continue  # here what is declared counts too
        assert g["lang_p"] == pytest.approx(p[best], abs=2e-4) and (g["lang_id"] == best or p[best] < 0.51)
