"""The queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.llm import chat, exact_dedup, jaccard_join, language_id, licenses, mixing, packing, quality, secrets, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through one ledger in two deliveries of sources; the second scans only what the first has not seen."""
    docs, ledger = _table(spark, sf_dir, "documents"), secrets.fresh_ledger(spark)
    first = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) < 1 << 31
    parts = [secrets.scan_versions(docs.filter(delivered), ledger, "doc_id") for delivered in (first, ~first)]
    found = parts[0].unionByName(parts[1])
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")
    kinds = F.transform("findings", lambda f: f["rule"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(F.col("path").alias("doc_id"), *counts, spans.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sequence", F.size("rules").cast("long").alias("n_rules"), F.array_join("licences", ",").alias("licences"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    rows = rows.withColumn("_source", rows["sources"][0])
    # one row a source: bounded by the operator's check of its patterns
    return rows.join(F.broadcast(sources), rows["_source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = chat.rotate(_table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return drawn.select("conv_id", "perspective", "part", "n_messages", "text", masks.alias("masks"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_rules, op3_language_id, op4_license_scan, op5_mixing_sources,
        op6_jaccard_join, op7_best_fit_packing, op8_chat_rotation, op9_suffix_dedup, op10_exact_dedup,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_any_case('api')}_?{_any_case('key')}"
_PATTERNS = {
    "assign": f"""({_KEYS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def _secret_matches(kind: str, number: int, group: int, least: int) -> str:
    pattern = _quoted(_PATTERNS[kind])
    return f"""
        select doc_id, {number} as k, '{kind}' as kind, "end" - size as start, "end" from (
          select doc_id, size, part, sum(gap + size) over (partition by doc_id order by i) as "end" from (
            select doc_id, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(m, lambda x: length(x))) as size,
                   unnest(list_transform(g, lambda x: length(x))) as part, unnest(list_transform(s[1:len(m)], lambda x: length(x))) as gap
            from (select doc_id, regexp_extract_all(t, {pattern}, 0) as m, regexp_extract_all(t, {pattern}, {group}) as g,
                         string_split_regex(t, {pattern}) as s from d where regexp_matches(t, {pattern})))) where part >= {least}"""


_MATCHES = " union all ".join(_secret_matches(*x) for x in (("assign", 0, 2, 6), ("access", 1, 0, 20), ("hex", 2, 0, 24)))

_KNOWN = "map {" + ", ".join(f"{_quoted(licenses.normalised(s))}: '{name}'" for name, s in licenses.SENTENCES) + "}"
_LICENCES = "map {" + ", ".join(f"'{licenses.marked_off(rule)}': '{licence}'" for licence, rule in licenses.RULES) + "}"
_ORDERED = licenses.ordered(licenses.RULES)

ORACLE_SQL = {
    "op1_secret_scan": f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        f as ({_MATCHES}),
        a as (select doc_id, sum((k = 0)::int)::bigint as n_assign, sum((k = 1)::int)::bigint as n_access, sum((k = 2)::int)::bigint as n_hex,
                     string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, k) as spans from f group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               coalesce(spans, '') as spans, sha256(coalesce(spans, '')) as base_sha256
        from d left join a on d.doc_id = a.doc_id""",
    "op4_license_scan": f"""
        with d as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?;]+([ \\t\\n\\x0B\\f\\r]|\\z)', chr(10), 'g'), chr(10)) as parts from documents),
        s as (select doc_id, list_filter(list_transform(parts, lambda x: ({_KNOWN})[lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))]), lambda x: x is not null) as ids from d),
        q as (select doc_id, coalesce(array_to_string(ids, ' '), '') as sequence from s),
        r as (select doc_id, sequence, regexp_extract_all('<' || replace(sequence, ' ', '><') || '>', '{_ORDERED}') as rules from q)
        select doc_id, sequence, len(rules)::bigint as n_rules,
               coalesce(array_to_string(list_transform(rules, lambda x: ({_LICENCES})[x]), ','), '') as licences from r""",
    "op8_chat_rotation": f"""
        with m as (select distinct conv_id, turn, role, text from conversations),
        p as (select distinct conv_id, role as perspective from m where role is not null and role <> 'system'),
        o as (select *, (row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1) // {chat.PART} as part from m),
        j as (select m.conv_id, perspective, part, turn, role, text, role is not null and role = perspective as own,
                     case when role is null then '<|user|>' when role = 'system' then '<|system|>' when role = perspective then '<|assistant|>'
                          else '<|user name=' || replace(role, '<|', '< |') || '|>' end || chr(10) as head,
                     replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as body
              from o as m join p on m.conv_id is not distinct from p.conv_id),
        e as (select *, sum(length(head) + length(body)) over (partition by conv_id, perspective, part
                     order by turn nulls first, role nulls first, text nulls first rows unbounded preceding) as "end" from j)
        select conv_id, perspective, part, count(*) as n_messages,
               string_agg(head || body, '' order by turn nulls first, role nulls first, text nulls first) as text,
               coalesce(string_agg(("end" - length(body))::bigint || ':' || "end"::bigint, ',' order by "end") filter (own), '') as masks
        from e group by conv_id, perspective, part""",
    "op10_exact_dedup": f"""
        with d as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)""",
}
