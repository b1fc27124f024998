"""Language of web pages by Bayesian evidence fusion.

The posterior of a language multiplies, in logarithms: the likelihood of the page's visible text under the
language's byte trigrams; the likelihood of what the markup declares and of the address suffix, each learned from
how often pages that read as the language declare it or have it; and a prior of the page's host, which
is smoothed towards its domain's, that one towards its suffix's and that one towards all pages'. A page's
own share is taken out of all counts that it is judged by, so no page is its own evidence.

All tables come from grouped aggregation over all rows: trigram counts by language over all texts with a
language, then over all pages. A text's likelihood is per trigram, times at most ``TEXT_WEIGHT`` trigrams, since
neighbouring trigrams say much the same. Null, empty and broken pages and addresses add no evidence
of that kind; without any, the prior decides. Ties go to the language first in order. Pages are judged row by row:
repeated rows count as often as they occur. Without labelled texts there is no language and the result is
empty of one (null). Columns other than the named ones are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land

BUCKETS = 1 << 14
TEXT_WEIGHT = 40
# Pages that the next wider level counts as, in the prior of a host, domain and suffix.
SMOOTH = 5.0

_HIDDEN = re.compile(r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def visible_text(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of all byte trigrams of the text's letters, words apart by one space."""
    letters = " " + _NOT_LETTERS.sub(" ", (text or "").lower()).strip() + " "
    data = np.frombuffer(letters.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(18)).astype(np.int64)


def trigram_counts(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all texts that have a language."""

    def counts(batches):
        seen: dict[str, np.ndarray] = {}
        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"]):
                own = np.bincount(trigrams(text), minlength=BUCKETS)
                seen[lang] = seen[lang] + own if lang in seen else own
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    rows = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trigram_model(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of buckets (one row per language).

    The driver gets at most ``BUCKETS`` sums for each language.
    """
    rows = trigram_counts(texts, text_col, lang_col).collect()
    langs = sorted({r["lang"] for r in rows})
    sums = np.full((len(langs), BUCKETS), 0.5)
    for r in rows:
        sums[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(sums / sums.sum(axis=1, keepdims=True))


_EVIDENCE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("host", "domain", "suffix", "declared")] + [T.StructField("text", T.ArrayType(T.DoubleType()))]
)


def evidence_of(url: str | None, page: str | None, logs: np.ndarray) -> tuple:
    """Host, domain, suffix, declared language, and the text's log likelihood under each language."""
    found = _HOST.match(url or "")
    host = found.group(1).lower().rstrip(".") if found else None
    labels = host.split(".") if host else []
    named = len(labels) > 1 and not labels[-1].isdigit()
    domain = ".".join(labels[-2:]) if named else host
    said = _DECLARED.search(page or "")
    buckets = trigrams(visible_text(page))
    text = logs[:, buckets].mean(axis=1) * min(len(buckets), TEXT_WEIGHT) if len(buckets) else np.zeros(len(logs))
    return host, domain, labels[-1] if named else None, said.group(1).lower() if said else None, text.tolist()


def _posterior(logs):
    """Normalised probabilities of an array of logarithms."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda w: w / total)


def _plus(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(rows: DataFrame, keys: list[str], probabilities: str, langs: int, name: str) -> DataFrame:
    """Sums of probabilities by key, as one array."""
    sums = [F.sum(F.col(probabilities)[k]) for k in range(langs)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def identify(
    pages: DataFrame,
    texts: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(page_id, host, declared, lang, probability), one row per page."""
    langs, logs = trigram_model(texts, text_col, lang_col)
    if not langs:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("declared", "string"), ("lang", "string"), ("probability", "double"))]
        return pages.select(F.col(id_col).alias("page_id"), *nothing)
    n = len(langs)

    @F.pandas_udf(_EVIDENCE)
    def evidence(urls: pd.Series, markup: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence_of(u, m, logs) for u, m in zip(urls, markup)], columns=_EVIDENCE.fieldNames())

    found = evidence(F.col(url_col), F.col(html_col))
    rows = land(pages.select(F.col(id_col).alias("page_id"), found.alias("e")).select("page_id", "e.*").withColumn("read", _posterior(F.col("text"))))

    none = F.array(*[F.lit(0.0)] * n)

    def with_clue(told: DataFrame, key: str) -> DataFrame:
        """Log likelihood of a clue's value under each language, by the other pages; each total is smoothed by one page."""
        sums = _sums(rows.where(F.col(key).isNotNull()), [key], "read", n, "_s")
        totals = sums.agg(F.array(*(F.sum(F.col("_s")[k]) for k in range(n))).alias("_t"), F.count(F.lit(1)).alias("_values"))

        def others(counts: str, k: int):
            return F.greatest(F.col(counts)[k] - F.col("read")[k], F.lit(0.0))

        logged = F.array(*[F.log((others("_s", k) + 1.0 / F.col("_values")) / (others("_t", k) + 1.0)) for k in range(n)])
        joined = told.join(sums, key, "left").crossJoin(F.broadcast(totals))  # one row
        return joined.withColumn(f"log_{key}", F.when(F.col(key).isNotNull(), logged).otherwise(none)).drop("_s", "_t", "_values")

    told = with_clue(with_clue(rows, "declared"), "suffix")
    told = told.withColumn("log_clues", _plus(F.col("log_declared"), F.col("log_suffix")))
    told = land(
        told.withColumn("own", _posterior(_plus(F.col("text"), F.col("log_clues")))).select(
            "page_id", "host", "domain", "suffix", "declared", "text", "log_clues", "own"
        )
    )

    # counts of pages by language on each level; each is smoothed towards the next wider one
    everywhere = told.agg(F.array(*(F.sum(F.col("own")[k]) for k in range(n))).alias("n_all"))
    by_suffix = _sums(told.where("suffix IS NOT NULL"), ["suffix"], "own", n, "n_suffix")
    by_domain = _sums(told.where("domain IS NOT NULL"), ["domain"], "own", n, "n_domain")
    by_host = _sums(told.where("host IS NOT NULL"), ["host"], "own", n, "n_host")
    counted = (
        told.join(by_host, "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left").crossJoin(F.broadcast(everywhere))
    )

    def smoothed(counts, wider):
        """Shares of a level without the page itself, with SMOOTH pages like those of the wider level."""
        others = F.transform(F.zip_with(F.coalesce(counts, F.col("own")), "own", lambda c, o: c - o), lambda x: F.greatest(x, F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda s, x: s + x) + SMOOTH
        return F.zip_with(others, wider, lambda c, w: (c + SMOOTH * w) / total)

    even = F.array(*[F.lit(1.0 / n)] * n)
    for level, wider in (("n_all", even), ("n_suffix", F.col("n_all")), ("n_domain", F.col("n_suffix")), ("n_host", F.col("n_domain"))):
        counted = counted.withColumn(level, smoothed(F.col(level), wider))
    fused = _plus(_plus(F.col("text"), F.col("log_clues")), F.transform("n_host", lambda p: F.log(p)))
    final = counted.withColumn("posterior", _posterior(fused))
    best = F.array_max("posterior")
    place = F.array_position("posterior", best)
    return final.select(
        "page_id", "host", "declared", F.element_at(F.array(*map(F.lit, langs)), place.cast("int")).alias("lang"), best.alias("probability")
    )
