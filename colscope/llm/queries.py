"""The operators as queries over the whole table of documents, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm import (bpe, exact_dedup, hard_negatives, language, licenses, manifest, mixing, pii, quality_classifier,
                          quality_rules, sharding, simhash, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SHARDS = 16


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op2_license_scans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(documents(spark, folder)).drop("detections")


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classified(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op4_exact_dedup", """
    with t as (
        select doc_id, length(coalesce(text, '')) as n,
            sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256
        from documents),
    g as (
        select *, first(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
            count(*) over (partition by text_sha256) as group_size
        from t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, folder))


def _mixing_sql(recipe: mixing.Recipe) -> str:
    def named(column: str, pairs: dict, other: str) -> str:
        whens = " ".join(f"when {column} in ({', '.join(repr(x) for x in v)}) then {k}" for k, v in pairs.items())
        return f"case {whens} else {other} end" if whens else other

    def weight(level: str) -> str:
        names: dict[int, list[str]] = {}
        for name, w in recipe.weights.get(level, {}).items():
            names.setdefault(w, []).append(name)
        return named(level, names, str(recipe.other))

    steps, above = [], []
    for level in mixing.LEVELS:
        path = [*above, level]
        by, cols = f"partition by {', '.join(above)}" if above else "", ", ".join(path)
        given = f"join {above[-1]}_budgets using ({', '.join(above)})" if above else ""
        budget = "budget" if above else f"(select sum(n_tokens) * {recipe.numerator} // {recipe.denominator} from leaves)"
        steps.append(f"""
    {level}_nodes as (
        select {cols}, cap, {budget}::hugeint as budget, ({weight(level)})::hugeint as w
        from (select {cols}, sum(n_tokens * {recipe.epochs})::hugeint as cap from leaves group by all) {given}),
    {level}_ordered as (
        select *, budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as remaining,
            sum(w) over (o rows between current row and unbounded following) as open_w
        from {level}_nodes window o as ({by} order by cap::double / w::double, {level})),
    {level}_filled as (select *, cap = 0 or cap * open_w <= remaining * w as filled from {level}_ordered),
    {level}_budgets as (
        select {cols}, case when filled then cap else
            (budget - coalesce(sum(cap) filter (filled) over ({by}), 0)) * w // (sum(w) filter (not filled) over ({by})) end as budget
        from {level}_filled)""")
        above = path
    domain = named("source", {f"'{k}'": list(v) for k, v in recipe.domains.items()}, f"'{recipe.other_domain}'")
    names = ", ".join(mixing.LEVELS)
    return f"""
    with named as (
        select doc_id, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key, coalesce(lang, '{mixing.MISSING}') as lang, coalesce(source, '{mixing.MISSING}') as source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens
        from documents),
    counted as (select doc_id, key, {domain} as domain, lang, source, n_tokens from named),
    leaves as (select {names}, sum(n_tokens) as n_tokens from counted group by all),
    {','.join(steps)},
    plan as (
        select {names}, case when n_tokens = 0 then 0 else budget // n_tokens end as whole,
            case when n_tokens = 0 then 0 else budget % n_tokens end as rest
        from leaves join {mixing.LEVELS[-1]}_budgets using ({names})),
    placed as (
        select *, sum(n_tokens) over (partition by {names} order by digest) as upto
        from (select *, md5('{recipe.seed}:' || (whole + 1)::varchar || ':' || key) as digest
              from counted join plan using ({names})))
    select doc_id, {names}, n_tokens::bigint as n_tokens,
        (whole + case when whole < {recipe.epochs} and upto <= rest then 1 else 0 end)::bigint as epochs
    from placed"""


@query("op5_source_mixing", _mixing_sql(mixing.Recipe()))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.chosen(documents(spark, folder))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    machine = token_counts.automaton(token_counts.read_pieces(public_tokenizers.path(PIECES)))
    return token_counts.counted(documents(spark, folder), machine)


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(documents(spark, folder), [1.0] * SHARDS, [1.0] * (SHARDS + 1)).withColumn("law", F.lit("key"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(documents(spark, folder), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(documents(spark, folder))


@query("op10_simhash_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.mark(documents(spark, folder)).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op11_pii")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digested(pii.found(documents(spark, folder)))


@query("op12_hard_negatives", """
    with t as (
        select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as v
        from embeddings
        where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, b.label = a.label as alike, list_dot_product(a.v, b.v)::bigint as score
        from t a join t b on a.row <> b.row where a.vec_id % 50 = 0),
    positives as (
        select * from scored where alike
        qualify row_number() over (partition by anchor order by score desc, vec_id nulls last) <= 5)
    select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor, p.row order by n.score desc, n.vec_id nulls last)::int as rank,
        n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
    from positives p join scored n on n.anchor = p.anchor and not n.alike
        and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
    qualify rank <= 3""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = rows.withColumn("label", hard_negatives.shifted(F.col("vec_id"), F.col("label")))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


def _manifest_sql() -> str:
    def leaf(n_chars: str) -> str:
        values = ["doc_id", "source", "lang", n_chars, "text"]
        fields = [f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')" for v in values]
        return f"sha256({' || '.join(fields)})"

    def tree(name: str, leaves: str, by: str, order: str) -> str:
        same = lambda a, b: " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in by.split(", "))
        return f"""
    {name}_nodes as (
        select {by}, 0 as lvl, row_number() over (partition by {by} order by {order}) - 1 as pos, count(*) over (partition by {by}) as m,
            node as h from {leaves}
        union all
        select {by}, lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' order by pos)) from {name}_nodes where m > 1
        group by {by}, lvl, pos // 2, m),
    {name}_places as (select *, row_number() over (partition by {by} order by {order}) - 1 as pos from {leaves}),
    {name}_levels as (select distinct {by}, lvl from {name}_nodes where m > 1),
    {name}_witnesses as (
        select p.*, coalesce(list(case when n.h is null then '-' when n.pos % 2 = 0 then '<' || n.h else '>' || n.h end order by l.lvl)
            filter (l.lvl is not null), []) as witness
        from {name}_places p left join {name}_levels l on {same("p", "l")}
        left join {name}_nodes n on {same("p", "n")} and n.lvl = l.lvl and n.pos = xor(p.pos >> l.lvl, 1)
        group by all)"""

    crc = ("xor(list_reduce(list_transform(range(length(doc_id::varchar)), lambda i: ord(substr(doc_id::varchar, i + 1, 1))::bigint), "
           "lambda c, b: list_reduce(range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295), 4294967295)")
    fold = ("list_reduce(witness || rest, lambda a, s: sha256(case s[1] when '<' then s[2:] || a when '>' then a || s[2:] else a end), "
            "coalesce(forged, node))")
    return f"""
    with recursive leaves as (
        select doc_id, lang, {leaf("n_chars")} as node,
            case when {crc} % 7 = 0 and n_chars is not null then {leaf("n_chars::hugeint + 1")} end as forged
        from documents),
    {tree("inside", "leaves", "lang", "doc_id nulls first, node")},
    subroots as (select true as one, lang, h as node from inside_nodes where m = 1),
    {tree("outside", "subroots", "one", "lang nulls first")},
    whole as (
        select w.doc_id, w.node, w.forged, w.witness, o.node as subroot, o.witness as rest, (select h from outside_nodes where m = 1) as root
        from inside_witnesses w join outside_witnesses o on w.lang is not distinct from o.lang)
    select doc_id, node as leaf, subroot, root,
        sha256(array_to_string(list_transform(list_filter(witness || rest, lambda s: s <> '-'), lambda s: s[2:]), '')) as proof_sha256,
        {fold} as folded_root, folded_root = root as verified
    from whole"""


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audited(manifest.manifest(documents(spark, folder), manifest.few_changed()))
