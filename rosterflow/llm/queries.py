"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, lm_score, merkle, near_dup, packing, pieces, quality, secrets, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest_report(merkle.verify_manifest(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_lm_score, op3_packing, op4_secrets, op5_html_extraction, op6_warc, op7_quality_rules, op8_sentencepiece, op9_toxicity, op10_near_dedup,
        op11_merkle_manifest, op12_vector_codes, op13_byte_bpe, pipeline,
    )
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fields(*values: str) -> str:
    return " || ".join(f"coalesce(strlen({v}::varchar)::varchar || ':' || {v}::varchar, '-')" for v in values)


#: crc32 of an id's decimal digits, byte by byte and bit by bit.
CRC32_OF_ID = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::bigint)"""

MERKLE_SQL = f"""
with recursive leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n, row_number() over () as r
    from (
        select doc_id, coalesce(':' || lang, '-') as tree, sha256({_fields("doc_id", "source", "lang", "n_chars", "text")}) as leaf,
            case when {CRC32_OF_ID} % 7 = 0 and n_chars is not null then sha256({_fields("doc_id", "source", "lang", "(n_chars + 1)", "text")}) end as altered
        from documents)),
low(tree, level, place, n, digest) as (
    select tree, 0, place, n, leaf from leaves
    union all
    select tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by place)) from low where n > 1 group by tree, level, place // 2, n),
tops as (select tree, digest as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n from low where n = 1),
high(level, place, n, digest) as (
    select 0, place, n, subroot from tops
    union all
    select level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by place)) from high where n > 1 group by level, place // 2, n),
steps as (
    select l.r, me.level, l.place >> me.level & 1 as side, sib.digest as sib
    from leaves l join low me on me.tree = l.tree and me.n > 1 and me.place = l.place >> me.level
    left join low sib on sib.tree = me.tree and sib.level = me.level and sib.place = xor(me.place, 1)
    union all
    select l.r, 1000 + me.level, t.place >> me.level & 1, sib.digest
    from leaves l join tops t on t.tree = l.tree join high me on me.n > 1 and me.place = t.place >> me.level
    left join high sib on sib.level = me.level and sib.place = xor(me.place, 1)),
paths as (
    select r, string_agg(sib, '' order by level) as proof, list(case when sib is null then 'o' when side = 1 then 'l' || sib else 'r' || sib end order by level) as way
    from steps group by r),
folds as (
    select l.*, coalesce(proof, '') as proof, list_reduce(list_prepend(coalesce(altered, leaf), coalesce(way, [])),
        lambda a, s: sha256(case s[1] when 'l' then s[2:] || a when 'r' then a || s[2:] else a end)) as folded_root
    from leaves l left join paths using (r))
select doc_id, leaf, subroot, high.digest as root, sha256(proof) as proof_sha256, folded_root, folded_root = high.digest as verified
from folds f join tops t on t.tree = f.tree join high on high.n = 1
"""


def _code_round(k: int) -> str:
    """Assignment of all parts with the entries so far, and the entries that follow."""
    return f"""
a{k} as (
    select r, p, min({{'d': list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': e}}) as best
    from s join b{k} b using (p) group by r, p),
n{k} as (
    select p, e, i, ((t - (t % c + c) % c) // c)::bigint as v from (
        select p, best.e as e, i, sum(y)::bigint as t, count(*) as c
        from a{k} join (select r, p, unnest(x) as y, unnest(range(1, len(x) + 1)) as i from s) using (r, p) group by p, best.e, i)),
b{k + 1} as (
    select b.p, b.e, coalesce(n.x, b.x) as x from b{k} b left join (select p, e, list(v order by i) as x from n{k} group by p, e) n on n.p = b.p and n.e = b.e)"""


CODES_SQL = f"""
with v as (
    select *, row_number() over (order by vec_id, x) as r from (
        select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)),
s as (select r, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] as x from v, range(16) g(p)),
b0 as (select p, r - 1 as e, x from s where r <= 64),
{_code_round(0)},
{_code_round(1)},
a2 as (
    select r, p, min({{'d': list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': e}}) as best
    from s join b2 b using (p) group by r, p),
coded as (select r, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a2 group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from b2) as codebooks_sha256
from coded join v using (r)
"""

#: SQL has no base32 for op6; that and the queries without an entry are held against brute force in the tests.
ORACLE_SQL = {
    "op1_exact_dedup": f"""
        with d as (select doc_id, {LOWERED} as t from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from d window w as (partition by t)""",
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_vector_codes": CODES_SQL,
}
