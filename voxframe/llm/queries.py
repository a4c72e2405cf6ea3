"""The operators over the test tables, as registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import compressor, counting, decontaminate, idfiles, neardup, packing, periodic, quality, ranking, scoring, secrets, sharding, substrings

VOCABULARIES = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json"}
SHARDS = 24


def vocabulary(kind: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARIES[kind])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("words"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.find("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("bigint").alias("n_confirmed"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    limits = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality.measures("text", limits=limits, lang="lang").alias("m")).select("doc_id", "m.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole_slots=False).drop("text_hash")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(SHARDS), sharding.tree(SHARDS + 1))
    return placed.withColumn("law", F.lit("key"))


def op7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"), vocabulary("words"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_ids(idfiles.write_ids(table(spark, sf_dir, "documents"), vocabulary("bytes")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: one document in ten with its tail replaced by a repeated period, as op12 asks; others and NULL ids unchanged."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0), words).alias("words"))
    n = F.size("words")
    first = (F.col("g") % n).cast("int")
    placed = some.select("doc_id", "text", "words", "g", F.when(n > 0, first).alias("a")).select(
        "doc_id", "text", "words", "a", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    changed = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), n), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(table(spark, sf_dir, "documents")))

    def before(a: Column, b: Column) -> Column:
        """The greater exact length / period first, then the smaller start and period."""
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"), best.alias("best")).select(
        "doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def learnable(doc_id: str) -> Column:
    """Ids whose labels may be learned from: crc32 of the id as text leaves no 1 by 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


def op13_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compressor.fit(docs, table(spark, sf_dir, "labels"), learnable("_id"))
    held_out = F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out")
    return compressor.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_secrets, op3_substrings, op4_quality, op5_decontamination, op6_sharding, op7_scores,
                                   op8_token_counts, op9_simhash, op10_id_files, op11_ranked_search, op12_periodic_runs, op13_compression_classifier, pipeline)}

# every 13-word window with the smallest document it starts in; a word goes if a window over it has a smaller one
SUBSTRING_SQL = """
with words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
 places as (select doc_id, w, unnest(range(len(w) - 12)) as p from words where len(w) >= 13),
 windows as (select doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') as g from places),
 firsts as (select g, min(doc_id) as least from windows group by g),
 gone as (select distinct doc_id, p + k as p from windows join firsts using (g), (select unnest(range(13)) as k) where least < doc_id),
 lost as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
 sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(ps, i - 1)) end, ' ')) as kept_sha256
from words left join lost on words.doc_id = lost.doc_id
"""

# scores of all documents for all items from counted terms
SEARCH_SQL = """
with terms as (select doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) as term from documents),
 asked as (select item_id, term, count(*) as times from (select item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) as term from benchmark) group by all),
 lengths as (select doc_id, count(*) as n from terms group by doc_id),
 corpus as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
 counts as (select doc_id, term, count(*) as tf from terms group by all),
 weights as (select term, cast(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from counts, corpus group by term),
 parts as (select item_id, doc_id, times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as part
   from asked join weights using (term) join counts using (term) join lengths using (doc_id), corpus),
 scores as (select item_id, doc_id, cast(sum(part) as bigint) as score from parts group by all having sum(part) > 0),
 ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 20
"""


ORACLE = {"op3_substrings": SUBSTRING_SQL, "op11_ranked_search": SEARCH_SQL}
