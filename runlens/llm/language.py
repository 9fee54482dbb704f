"""Language identification by fusing four kinds of evidence.

* text: letter trigrams, hashed into 2^15 bins, counted per language over all training texts (partial sums, then a sum
  by language and bin); a text's log-likelihood under each language is divided by three, since trigrams overlap;
* the language that the markup declares, and that the address names (a country suffix, else a path that begins with a language):
  each is right with a given probability and else any of the other languages;
* the host: the share of each language among the host's texts, by text evidence alone, smoothed towards that of its
  registered domain, that towards its suffix's, and that towards that of all texts (grouped aggregations).

The posterior is the normalised product. The tables sent to tasks hold at most 2^15 bins for each language; host shares are joined.

Edge cases: null, empty and letterless texts have no text evidence and are settled by the rest; a null url or host is a
host of its own; declared languages that training does not know are no evidence. Ties go to the language
that comes first in the alphabet. Without training texts the language is null. Repeated rows are judged each, empty tables give
no rows. ``keep_known`` carries extra columns whatever their names.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, per_worker, spare, written
from .url_reputation import registered_domain, suffix, url_host, url_path

BINS = 1 << 15
SMOOTHING = 0.5
OVERLAP = 3
#: probability that the markup, and the address, name the right language
DECLARED, ADDRESS = 0.9, 0.8
#: texts that the level above counts for, from host to all
PRIOR = 20.0
#: a text whose own column names a language of lower posterior is rejected
LEAST_POSTERIOR = 0.01
SLICE = 1 << 20
#: fixed values: country suffixes that name a language
SUFFIX_LANG = {
    "at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en",
}

_HIDDEN = re.compile(r"<(script|style|title)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_MARKUP = re.compile(r"<[^>]*>")


def visible_text(html: str) -> str:
    return htmllib.unescape(_MARKUP.sub(" ", _HIDDEN.sub(" ", html)))


def letter_table() -> np.ndarray:
    """Code of every character of the first plane: itself if it is a letter, else 0; 1 for all beyond."""
    return np.array([*[i if chr(i).isalpha() else 0 for i in range(1 << 16)], 1], np.uint32)


def trigram_bins(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of the trigrams of the lower-cased text; runs of other characters count as one gap."""
    for at in range(0, len(text), SLICE):
        codes = table[np.minimum(np.frombuffer(text[max(0, at - 2):at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)]
        codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
        if not codes.any():
            continue
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        h = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
        yield (h ^ (h >> np.uint32(15))) * np.uint32(668265263) >> np.uint32(17)


def count_trigrams(texts: DataFrame) -> DataFrame:
    """``lang, bin, n`` of the columns ``lang, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = per_worker("letters", letter_table), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                total = totals.setdefault(lang, np.zeros(BINS, np.int64))
                for bins in trigram_bins(text.as_py() or "", table):
                    np.add.at(total, bins, 1)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen])], names=["lang", "bin", "n"])

    return texts.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, and the log-probability of every bin under each."""

    def __init__(self, counts: DataFrame) -> None:
        rows = counts.toPandas()  # at most BINS rows for each language
        self.langs = sorted(rows["lang"].unique())
        n = np.full((BINS, len(self.langs)), SMOOTHING)
        n[rows["bin"].to_numpy(), np.searchsorted(self.langs, rows["lang"].to_numpy())] += rows["n"].to_numpy()
        self.table = np.log(n / n.sum(axis=0)).astype(np.float32)


def train(texts: DataFrame) -> Model:
    return Model(count_trigrams(texts))


def likelihoods(df: DataFrame, text: str, model: Model, name: str, html: bool = False) -> DataFrame:
    """``df`` with the log-likelihoods of its texts under each language (null without a letter)."""
    shared = df.sparkSession.sparkContext.broadcast(model.table)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = per_worker("letters", letter_table), shared.value
        for batch in batches:
            out = []
            for t in batch.column(at):
                t, total, seen = t.as_py() or "", np.zeros(table.shape[1]), False
                for bins in trigram_bins(visible_text(t) if html else t, letters):
                    total, seen = total + table[bins].sum(axis=0, dtype=np.float64), True
                out.append((total / OVERLAP).tolist() if seen else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def _best(values: Column) -> Column:
    """0-based place of the largest."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def host_shares(found: DataFrame, n_langs: int, prior: float = PRIOR) -> DataFrame:
    """``host``, ``shares`` (array by language) from ``host, domain, suffix, like``."""
    k = F.sequence(F.lit(0), F.lit(n_langs - 1))
    votes = found.where("like is not null").groupBy("host", "domain", "suffix", _best(F.col("like")).alias("lang")).agg(F.count("*").alias("n"))
    hosts = found.select("host", "domain", "suffix").distinct()
    levels = [written(votes.groupBy(*keys, "lang").agg(F.sum("n").alias("n")), "votes") for keys in ((), ("suffix",), ("domain", "suffix"), ("host", "domain", "suffix"))]

    def counts(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        pairs = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # at most one entry for each language
        table = level.groupBy(*keys).agg(pairs.alias("m"))
        return table.select(*keys, F.transform(k, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias(name))

    everything = counts(levels[0], [], "n_all").first()
    seen = everything["n_all"] if everything and everything["n_all"] else [0.0] * n_langs
    top = F.array(*[F.lit((x + 1.0) / (sum(seen) + n_langs)) for x in seen])
    joined = hosts.join(counts(levels[1], ["suffix"], "n_suffix"), "suffix", "left").join(counts(levels[2], ["domain", "suffix"], "n_domain"), ["domain", "suffix"], "left").join(counts(levels[3], ["host", "domain", "suffix"], "n_host"), ["host", "domain", "suffix"], "left")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    shares = top
    for name in ("n_suffix", "n_domain", "n_host"):
        own = F.col(name)
        joined = joined.withColumn("shares", F.when(own.isNull(), shares).otherwise(F.zip_with(own, shares, lambda x, p: (x + prior * p) / (total(own) + prior))))
        shares = F.col("shares")
    return joined.select("host", "shares")


def named(value: Column, langs: list[str], right: float) -> Column:
    """Log-probabilities that ``value`` is named under each language; zeros if training does not know it."""
    n = len(langs)
    if n < 2:
        return F.array(*[F.lit(0.0)] * n)
    wrong = float(np.log((1 - right) / (n - 1)))
    one = lambda lang: F.when(value == lang, float(np.log(right))).otherwise(wrong)
    return F.when(value.isin(langs), F.array(*[one(x) for x in langs])).otherwise(F.array(*[F.lit(0.0)] * n))


def posterior(like: Column, evidence: list[Column], n_langs: int) -> Column:
    total = F.coalesce(like, F.array(*[F.lit(0.0)] * n_langs))
    for e in evidence:
        total = F.zip_with(total, e, lambda a, b: a + b)
    weights = F.transform(total, lambda x: F.exp(x - F.array_max(total)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, address."""
    names, n = F.array(*[F.lit(x) for x in model.langs]), len(model.langs)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), declared.alias("declared"))
    if not n:
        return page.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", F.lit("").alias("address"))
    host = url_host(F.col("url"))
    country = F.create_map(*[F.lit(x) for pair in SUFFIX_LANG.items() for x in pair])
    first = F.lower(F.regexp_extract(url_path(F.col("url")), r"^/([A-Za-z]{2})(?:/|$)", 1))
    address = F.coalesce(F.try_element_at(country, suffix(host)), first)
    scores = written(likelihoods(page, "html", model, "like", html=True).select(
        "page_id", host.alias("host"), registered_domain(host).alias("domain"), suffix(host).alias("suffix"), "declared", address.alias("address"), "like"), "scores")
    shares = written(host_shares(scores, n), "shares")
    told = [named(F.col("declared"), model.langs, DECLARED), named(F.col("address"), model.langs, ADDRESS), F.transform("shares", lambda x: F.log(x))]
    fused = scores.join(shares, "host").withColumn("p", posterior(F.col("like"), told, n))
    at = _best(F.col("p"))
    return fused.select("page_id", F.get(names, at).alias("lang"), F.get("p", at).alias("confidence"), F.get(names, _best(F.col("like"))).alias("text_lang"), "declared", "address")


def keep_known(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of ``docs`` (text, lang, source) whose own ``lang`` the evidence does not refute, with their own columns.

    The column is the declared language, the source stands for the host. A row without a language, or with one that no
    other row has, stays."""
    model = train(docs.select("lang", "text"))
    n = len(model.langs)
    if not n:
        return docs
    like, source, share = spare(docs, "like", "source_key", "shares")
    by_source = written(likelihoods(docs.select("source", "text"), "text", model, "like").select(
        F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), "like"), "scores")
    shares = written(host_shares(by_source, n), "shares").select(F.col("host").alias(source), F.col("shares").alias(share))
    scored = likelihoods(docs, "text", model, like).withColumn(source, F.coalesce("source", F.lit("")))
    told = [named(F.col("lang"), model.langs, DECLARED), F.transform(share, lambda x: F.log(x))]
    p = posterior(F.col(like), told, n)
    own = F.get(p, F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang")).cast("int") - 1)
    return scored.join(shares, source).where(own.isNull() | (own >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_pages(load(spark, folder, "pages"), train(load(spark, folder, "documents")))
