"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.llm import bond, bpe_chunks, exact_dedup, jaccard_join, kneser_ney, language_id, lz_fingerprint, merkle, mixing, secret_scan, suffix_dedup, surrogates, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_surrogates")
def op5_surrogates(spark, folder):
    return surrogates.replaced(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op6_exact_dedup", """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
""")
def op6_exact_dedup(spark, folder):
    found = exact_dedup.decisions(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op7_mixing", """
    with recursive rate as (
        select source, (1.0::double / (select count(distinct source) from documents))
               * (select count(*) from documents)::double / count(*)::double as rate
        from documents group by source),
    part as (select source, greatest(1, ceil(rate / 16.0::double)::int) as parts, rate from rate),
    pmf as (
        select source, parts, rate / parts as lam, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as c from part
        union all
        select source, parts, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) from pmf
        where k < ceil(lam + 12.0::double * sqrt(lam) + 24.0::double)),
    draw as (
        select d.doc_id, d.source, p.parts, i.part,
               (('0x' || substr(md5('mix-1|' || d.doc_id || '|' || i.part), 1, 12))::bigint::double + 0.5::double) / 281474976710656.0::double as u
        from documents d join part p using (source), lateral (select unnest(range(1, p.parts + 1)) as part) i),
    total as (
        select doc_id, source, sum(n)::int as copies from (
            select d.doc_id, d.source, d.part, count(p.k) as n
            from draw d left join pmf p on p.source = d.source and p.c < d.u group by all) group by all),
    copy as (select doc_id, source, copies, unnest(range(1, copies + 1))::int as copy from total where copies > 0)
    select c.doc_id, c.source, d.text, c.copies as mix_copies, c.copy as mix_copy,
           md5('mix-1|' || c.doc_id || '|' || c.copy || '|order') as mix_key
    from copy c join documents d using (doc_id)
""")
def op7_mixing(spark, folder):
    return mixing.mixed(table(spark, folder, "documents").select("doc_id", "source", "text"))


@query("op9_language_id")
def op9_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    found = language_id.predictions(docs, language_id.fit(docs.select("doc_id", "text", "lang")))
    return found.select(F.col("id").alias("doc_id"), language_id.held_out("id").alias("held_out"), "lang_pred", "score")


@query("op3_secret_scan")
def op3_secret_scan(spark, folder):
    found = secret_scan.secrets(table(spark, folder, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


@query("op10_lz_fingerprint")
def op10_lz_fingerprint(spark, folder):
    return lz_fingerprint.neighbours(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, folder):
    found = suffix_dedup.repeats_removed(table(spark, folder, "documents").select("doc_id", "text"), kept=True)
    # a removed run may begin or end inside a character
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", text.alias("text"))


@query("op2_warc", f"""
    with pages_read as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
    same as (select *, max(page_id) over (partition by html) as top from pages_read)
    select page_id, payload_bytes, sha1(html) as payload_digest,
           case when payload_bytes >= {warc.REVISIT_FROM} and page_id < top then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= {warc.REVISIT_FROM} and page_id < top then top end as refers_to
    from same
""")
def op2_warc(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return warc.captured(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_bpe_chunks")
def op8_bpe_chunks(spark, folder):
    found = bpe_chunks.encoded(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, folder):
    scheme = jaccard_join.Scheme(width=3, share=90)
    found = jaccard_join.linked(table(spark, folder, "documents").select("doc_id", "text"), scheme)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


def _merkle_sql(levels: int = 10, top: int = 4) -> str:
    """Levels are spelled out: ten hold 8^10 rows of a language, four hold 8^4 languages."""
    up = "select tree, pos // 8 as pos, (any_value(n) + 7) // 8 as n, sha256(string_agg(node, '' order by pos)) as node from {0} where n > 1 group by tree, pos // 8"
    step = """select a.tree, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
        coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
        from {0} a join {0} b on a.tree = b.tree and a.pos // 8 = b.pos // 8 where a.n > 1 group by a.tree, a.pos"""
    part = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
            lambda v, z: xor(v >> 1, case when v & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint)"""
    fold = "case when {0}.l is null then f else sha256({0}.l || f || {0}.r) end"
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    parts = [f"""hashed as (select doc_id, coalesce('=' || lang, '') as tree, {leaf("text")} as node,
        case when {crc} % 3 = 0 then {leaf(lower)} end as changed from documents),
    l0 as (select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 as pos, count(*) over (partition by tree) as n from hashed)"""]
    parts += [f"l{k + 1} as ({up.format(f'l{k}')})" for k in range(levels)]
    parts.append("roots as (" + " union all ".join(f"select tree as name, node from l{k} where n = 1" for k in range(levels + 1)) + ")")
    parts.append("t0 as (select '' as tree, name, node, row_number() over (order by name) - 1 as pos, count(*) over () as n from roots)")
    parts += [f"t{k + 1} as ({up.format(f't{k}')})" for k in range(top)]
    parts.append("root as (" + " union all ".join(f"select node as root from t{k} where n = 1" for k in range(top + 1)) + ")")
    parts += [f"{c}p{k} as ({step.format(f'{c}{k}')})" for c, many in (("l", levels), ("t", top)) for k in range(many)]
    parts.append("f0 as (select x.doc_id, x.tree, x.node as leaf, x.pos, t.pos as place, t.node as subroot, coalesce(x.changed, x.node) as f, '' as p"
                 " from l0 x join t0 t on x.tree = t.name)")
    steps = [(f"lp{k}", f"s.tree = q.tree and s.pos // {8**k} = q.pos") for k in range(levels)] + [(f"tp{k}", f"s.place // {8**k} = q.pos") for k in range(top)]
    for i, (name, on) in enumerate(steps):
        parts.append(f"f{i + 1} as (select s.* replace ({fold.format('q')} as f, p || coalesce(q.l || q.r, '') as p) from f{i} s left join {name} q on {on})")
    return "with " + ",\n    ".join(parts) + f"""
    select doc_id, leaf, subroot, root, sha256(p) as proof_sha256, f as folded_root, f = root as verified from f{len(steps)}, root"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.manifest(
        docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"],
        replaced={"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
    )
    text = merkle.written
    return found.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), "verified",
    )


@query("op12_bond_negatives", """
    with whole as (
        select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
               list_transform(embedding, lambda x: floor(256 * x::double)) as v
        from embeddings
        where label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    scored as (
        select a.row as anchor_row, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
        from whole a join whole b on a.row <> b.row where a.vec_id % 100 = 0),
    positive as (
        select * from scored where same
        qualify row_number() over (partition by anchor_row order by score desc, vec_id, row) <= 5)
    select p.anchor_id, p.vec_id as positive_id,
           row_number() over (partition by p.anchor_row, p.row order by n.score desc, n.vec_id, n.row)::int as rank,
           n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
    from positive p join scored n on p.anchor_row = n.anchor_row and not n.same
         and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
    qualify row_number() over (partition by p.anchor_row, p.row order by n.score desc, n.vec_id, n.row) <= 5
""")
def op12_bond_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.mined(rows, "vec_id", label, bond.scaled(F.col("embedding")), F.col("vec_id") % 100 == 0)


@query("op11_kneser_ney")
def op11_kneser_ney(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return kneser_ney.scored(docs, kneser_ney.fit(docs)).withColumnRenamed("id", "doc_id")
