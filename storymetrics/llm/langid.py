"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: a naive Bayes model over hashed byte trigrams (letters folded), fitted on a bounded sample (SAMPLE distinct labelled
texts per language, of at most SAMPLE_CHARS characters); log likelihoods are tempered, since neighbouring trigrams depend on
each other. Markup: the declared language. Address: the last label of the host name. Host: a prior for each host that
is smoothed towards its domain's, which is smoothed towards all rows'. Declared languages, suffixes and priors are
counted over all other rows by grouped aggregation of the text posteriors. A row carries its posteriors as one array, and
arrays are fused element by element, so plans don't grow with the number of languages. What has no evidence of a kind
(null) is judged without it.

Defined results: of equally likely languages the last one in the alphabet is taken; null and empty texts, and those without letters, have only the other evidence; without any row of a
known language the result has null languages with confidence 0; equal rows get equal results; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text

SAMPLE, SAMPLE_CHARS = 400, 20_000
BUCKETS, TEMPER, SMOOTHING = 1 << 15, 8.0, 0.5
#: Rows' worth of weight of the domain's prior in a host's, and of the global prior in a domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 20.0
LEAST_CONFIDENCE = 0.5
#: Posteriors below this count as none, so that sums over rows only add up the languages that a text may be in.
LEAST_SHARE = 1e-12
#: Floats that are added up at once.
CELLS = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every three bytes of one row that hold a letter; what is no letter counts as a space."""
    folded = np.where(_LETTER[data], np.where((data >= 65) & (data <= 90), data + 32, data), 32).astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use = (row[:-2] == row[2:]) & (_LETTER[data[:-2]] | _LETTER[data[1:-1]] | _LETTER[data[2:]])
    return row[:-2][use], ((code[use] * np.uint32(2_654_435_761)) >> np.uint32(17)).astype(np.int64)


def sample(labelled: DataFrame) -> dict[str, list[str]]:
    """For each language the SAMPLE distinct texts with the smallest hashes, texts over SAMPLE_CHARS last and cut there.

    A bound that about 4 SAMPLE texts of a language pass comes first, since every task would send SAMPLE texts of each
    language otherwise. A second pass without the bound serves the languages whose copies or long texts leave too few.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", (F.length("text") > SAMPLE_CHARS).alias("long"), F.xxhash64("text").alias("key"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n")).collect()}

    def first(of: DataFrame) -> dict[str, list[str]]:
        one = of.groupBy("lang", "long", "key", F.substring("text", 1, SAMPLE_CHARS).alias("text")).agg(F.count("*").alias("copies"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "key", "text"))
        out: dict[str, list[str]] = {}
        for r in one.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "rank", "text").orderBy("lang", "rank").collect():
            out.setdefault(r["lang"], []).append(r["text"])
        return out

    if not n:
        return {}
    bounds = [(lang, (4 * SAMPLE * 2**64) // k - 2**63 if k > 4 * SAMPLE else 2**63 - 1) for lang, k in n.items()]
    bound = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    found = first(rows.where("NOT long").join(bound, "lang").where("key <= bound"))
    few = [(lang,) for lang in n if len(found.get(lang, ())) < SAMPLE and not 0 < n[lang] <= 4 * SAMPLE]
    if few:
        found |= first(rows.join(F.broadcast(labelled.sparkSession.createDataFrame(few, "lang string")), "lang"))
    return found


def fit(labelled: DataFrame) -> Model:
    """labelled: text and lang; every language with a text that isn't empty is known."""
    texts = sample(labelled)
    languages = sorted(texts)
    log_p = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        count = np.full(BUCKETS, SMOOTHING)
        for _, data, offsets in text.runs(pa.array(texts[lang], pa.large_string())):
            count += np.bincount(trigrams(data, offsets)[1], minlength=BUCKETS)
        log_p[:, k] = np.log(count / count.sum())
    return Model(languages, log_p.astype(np.float32))


def likelihoods(rows: DataFrame, model: Model, *more: str) -> DataFrame:
    """text -> p: the posteriors of all languages from the text alone under equal priors (null without letters)."""
    kept = rows.select(*more, "text")
    schema = kept.drop("text").schema.add("p", T.ArrayType(T.DoubleType()))
    out, shared, k = common.arrow_schema(schema), rows.sparkSession.sparkContext.broadcast(model.log_p), len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text.runs(b.column(len(more)), max(1 << 14, text.RUN_BYTES * 4 // max(4, k))):
                n = len(offsets) - 1
                row, bucket = trigrams(data, offsets)
                total = np.zeros((n, k))
                seen = np.bincount(row, minlength=n) > 0
                for i in range(0, len(row), max(1, CELLS // k)):
                    some = row[i : i + max(1, CELLS // k)]
                    start = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                    total[some[start]] += np.add.reduceat(shared.value[bucket[i : i + len(some)]], start, axis=0, dtype=np.float64)
                p = np.exp((total - total.max(axis=1, keepdims=True, initial=-np.inf)) / TEMPER)
                p /= p.sum(axis=1, keepdims=True)
                p[p < LEAST_SHARE] = 0.0
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(p.ravel()), mask=pa.array(~seen))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, n) for i in range(len(more))), listed], schema=out)

    return kept.mapInArrow(run, schema)


def sums(base: DataFrame, by: str, k: int) -> DataFrame:
    """(by, <by>_p): the posteriors of all rows with a value added up; only shares that aren't 0 are shuffled, summed before they are."""
    held = base.where(F.col("p").isNotNull() & F.col(by).isNotNull()).select(by, F.posexplode("p").alias("at", "share")).where("share > 0")
    one = held.groupBy(by, "at").agg(F.sum("share").alias("share"))
    listed = one.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("at", "share"))).alias("_all"))  # one entry a language at most
    return listed.select(by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_all", i), F.lit(0.0))).alias(f"{by}_p"))


def identify(rows: DataFrame, model: Model, *more: str) -> DataFrame:
    """`more`, language, confidence; rows: text, declared, suffix, host, domain (any of them null)."""
    k, kinds = len(model.languages), ("declared", "suffix", "domain", "host")
    if not k:
        return rows.select(*more, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"))
    base = common.saved(likelihoods(rows, model, *more, *kinds), "likelihoods")
    total = {r["at"]: r["share"] for r in base.select(F.posexplode("p").alias("at", "share")).groupBy("at").agg(F.sum("share").alias("share")).collect()}  # one row a language
    shares = [(total.get(i, 0.0) + 1) / (sum(total.values()) + k) for i in range(k)]
    every, none = F.lit(shares), F.array_repeat(F.lit(0.0), k)
    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    out = base
    for by in kinds:
        apart = F.coalesce(by, F.concat(F.lit("\0"), F.xxhash64(*more).cast("string")))  # rows without a value match nothing, and are spread
        out = out.withColumn("_key", apart).join(sums(base, by, k).withColumnRenamed(by, "_key"), "_key", "left").drop("_key")
        # of the other rows with the same value: a row is no evidence for itself
        own = F.when(F.col(by).isNotNull(), F.coalesce("p", none)).otherwise(none)
        out = out.withColumn(f"{by}_p", F.zip_with(F.coalesce(f"{by}_p", none), own, lambda s, o: F.greatest(s - o, F.lit(0.0))))

    def given(by: str) -> Column:
        """How much likelier the value is with each language than without evidence, in logs: smoothed P(value | language) / P(value)."""
        count = plus(F.col(f"{by}_p"))
        return F.when(F.col(by).isNull(), none).otherwise(F.zip_with(f"{by}_p", every, lambda n, e: F.log((n + SMOOTHING * e) / (e * (count + SMOOTHING)))))

    domains, hosts = plus(F.col("domain_p")), plus(F.col("host_p"))
    out = out.withColumn("_domain", F.zip_with("domain_p", every, lambda n, e: (n + DOMAIN_WEIGHT * e) / (domains + DOMAIN_WEIGHT)))
    prior = F.zip_with("host_p", "_domain", lambda n, d: F.log((n + HOST_WEIGHT * d) / (hosts + HOST_WEIGHT)))
    told = F.transform(F.coalesce("p", F.array_repeat(F.lit(1.0 / k), k)), lambda x: F.log(x + 1e-12))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    weight = add(add(add(told, given("declared")), given("suffix")), prior)
    out = out.select(*more, F.zip_with(weight, F.lit(model.languages), lambda w, lang: F.struct(w.alias("weight"), lang.alias("language"))).alias("all"))
    best = F.array_max("all")
    share = 1 / F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x["weight"] - best["weight"]))
    return out.select(*more, best["language"].alias("language"), share.alias("confidence"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id and the evidence of web pages: visible text, html lang attribute, and the url's host."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z]+://)?([^/:?#]+)", 1))
    full = lambda c: F.when(c != "", c)
    return pages.select("page_id", visible.alias("text"), full(declared).alias("declared"), full(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), full(host).alias("host"), full(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))


def document_evidence(documents: DataFrame) -> DataFrame:
    """doc_id and the evidence of documents: text, and the source as host; they have no markup and no address."""
    none = F.lit(None).cast("string")
    return documents.select("doc_id", "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def accepted(documents: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The documents but for those whose text holds no letters or whose language stays unclear (confidence below `least`).

    Rows with one doc_id go together; rows without doc_id are not judged by their language.
    """
    found = identify(document_evidence(documents).where(F.col("doc_id").isNotNull()), fit(documents), "doc_id")
    letters = F.coalesce("text", F.lit("")).rlike(r"\p{L}")
    silent = documents.where(~letters & F.col("doc_id").isNotNull()).select("doc_id")
    gone = common.saved(found.where(F.col("confidence") < least).select("doc_id").union(silent).distinct(), "gone")
    return documents.where(letters).join(common.sided(gone), "doc_id", "left_anti").select(documents.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged with a text model from the labelled documents."""
    model = fit(common.table(spark, sf_dir, "documents"))
    return identify(page_evidence(common.table(spark, sf_dir, "pages")), model, "page_id")
