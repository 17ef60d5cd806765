"""The numbered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(load(spark, sf_dir, "documents")))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(load(spark, sf_dir, "documents"))


@query(
    "op3_warc",
    """
    with p as (
      select page_id, encode(coalesce(html, '')) as b from pages
    ), d as (
      select page_id, octet_length(b) as n, sha1(b) as h from p
    ), k as (
      select h, max(page_id) as keeper from d where n >= 1000 group by h
    )
    select d.page_id, cast(n as bigint) as payload_bytes, d.h as payload_digest,
      case when keeper is null or d.page_id = keeper then 'response' else 'revisit' end as record_type,
      case when keeper is not null and d.page_id <> keeper then keeper end as refers_to
    from d left join k on d.n >= 1000 and d.h = k.h
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .warc import plan_records, read_warc, write_warc

    records = read_warc(write_warc(plan_records(load(spark, sf_dir, "pages"))), payloads=False)

    def page(c: str):
        digits = F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
        return F.when(digits != "", digits).cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@query(
    "op10_mixing",
    """
    with d as (
      select doc_id, source, text,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
        md5(concat_ws(':', '7', cast(doc_id as varchar), md5(text))) as h
      from documents
    ), s as (
      select source, cast(sum(size) as bigint) as source_size,
        1.0 + (row_number() over (order by source asc nulls last) - 1) % 3 as weight
      from d group by source
    ), c as (
      select source, cast(source_size as double) as source_size, cast(weight as double) as weight,
        3.0 * source_size as cap from s
    ), r as (
      select *,
        (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls first rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, source nulls first rows between current row and unbounded following) as level_here
      from c
    ), t as (
      select source, source_size, least(cap, weight * max(level_here) over ()) as target from r
    ), e as (
      select source, cast(source_size as bigint) as source_size, target,
        case when source_size > 0 then cast(floor(round(target) / source_size) as bigint) else 0 end as passes
      from t
    ), w as (
      select d.doc_id, d.source, d.size, e.source_size, e.target, e.passes,
        cast(round(e.target) as bigint) - e.passes * e.source_size as part,
        coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.text rows between unbounded preceding and 1 preceding), 0) as start
      from d join e on d.source is not distinct from e.source
    )
    select doc_id, size, source_size, target,
      cast(passes * size + greatest(0, least(size, part - start)) as bigint) as taken,
      cast(case when size > 0 then passes + cast(part > start as bigint) else 0 end as bigint) as copies
    from w
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import plan_mix

    plan = plan_mix(load(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("copies"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    return groups(load(spark, sf_dir, "documents"))


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring_dedup import remove_repeats

    rows = remove_repeats(load(spark, sf_dir, "documents"))
    words = F.aggregate("removed_spans", F.lit(0), lambda a, s: a + s["words"])
    return rows.select("doc_id", "text", words.alias("removed_words"), "removed_spans")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"), train=~held_out())
    rows = score(docs, model, keep=["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(load(spark, sf_dir, "documents"))


@query("op8_nearest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import nearest

    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_media")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import stored, text_bytes
    from .media import padded, read_payloads, store_payloads

    docs = load(spark, sf_dir, "documents").select("doc_id", text_bytes("text").alias("b"))
    rows = docs.select("doc_id", padded(F.col("b")).alias("payload"), F.octet_length("b").alias("n"))
    media = stored(store_payloads(rows, "payload", ["doc_id"], "n"), "media")
    back = read_payloads(media.withColumn("m", F.col("media")), ["doc_id", "media"], "m")
    tail = F.expr("substring(payload, -64, 64)")
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
