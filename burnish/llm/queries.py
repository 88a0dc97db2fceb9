"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- 1: exact top-k search -----------------------------------------------------


@register(
    "op1_topk_search",
    """WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
 FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    from burnish.llm.topk_search import top_inner_products

    return top_inner_products(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


# --- 2: quality classifier -----------------------------------------------------

#: A remainder of 0 holds a fifth of the ids out from training.
REMAINDER = "crc32(cast(doc_id AS string)) % 5"


@register("op2_quality_classifier")
def _(spark, sf):
    from burnish.llm.quality import score_quality

    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    scored = score_quality(docs, labels, train=F.expr(f"{REMAINDER} <> 0"))
    return scored.select("doc_id", F.coalesce(F.expr(f"{REMAINDER} = 0"), F.lit(False)).alias("held_out"), "score", "predicted")


# --- 3: line dedup -------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(
    "op3_line_dedup",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
)
def _(spark, sf):
    from burnish.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


# --- 4: n-gram Jaccard join ----------------------------------------------------


@register(
    "op4_ngram_join",
    f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)""",
)
def _(spark, sf):
    from burnish.llm.ngram_join import jaccard_groups

    return jaccard_groups(read(spark, sf, "documents"))


# --- 5: mixing sources to target weights ---------------------------------------

MIX_ROUNDS = 20
MARGINS = ("source", "lang", "topic")


def _raking_sql() -> str:
    """The cells' weights, one SELECT per margin and round."""
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
 CASE WHEN contains(t, 'license') OR contains(t, 'copyright') THEN 'legal' WHEN contains(t, ' | ') THEN 'tabular'
 WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact' ELSE 'prose' END AS topic,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
 FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents)),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(sum(tokens)) OVER ()::DOUBLE AS total FROM d GROUP BY ALL)"""
    ]
    for m in MARGINS:
        steps.append(
            f"t_{m} AS (SELECT {m}, pow(sum(tokens) / any_value(total), 0.85) AS s FROM c WHERE tokens > 0 GROUP BY {m})"
        )
        steps.append(f"n_{m} AS (SELECT {m}, s / sum(s) OVER () AS want_{m} FROM t_{m})")
    steps.append(
        "w0 AS MATERIALIZED (SELECT c.*, tokens / total AS w, want_source, want_lang, want_topic FROM c JOIN n_source USING (source)"
        " JOIN n_lang USING (lang) JOIN n_topic USING (topic) WHERE tokens > 0)"
    )
    k = 0
    for _ in range(MIX_ROUNDS):
        for m in MARGINS:
            k += 1
            steps.append(
                f"w{k} AS MATERIALIZED (SELECT * EXCLUDE (w), w * want_{m} / sum(w) OVER (PARTITION BY {m}) AS w FROM w{k - 1})"
            )
    steps.append(f"f AS (SELECT source, lang, topic, w * total / tokens AS weight, max(w * total / tokens) OVER () AS most FROM w{k})")
    return ", ".join(steps)


@register(
    "op5_mixing",
    f"""WITH {_raking_sql()}, j AS (SELECT doc_id, d.tokens::BIGINT AS tokens, coalesce(weight, 0) AS weight, coalesce(weight / most, 0) AS p,
 ('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
 FROM d LEFT JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic)
SELECT doc_id, tokens, round(weight, 6) AS weight, round(p, 6) AS probability, u < p AS kept FROM j""",
)
def _(spark, sf):
    from burnish.llm.mixing import mix_sources

    out = mix_sources(read(spark, sf, "documents"), rounds=MIX_ROUNDS)
    return out.select(
        "doc_id",
        F.col("mix_tokens").alias("tokens"),
        F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"),
    )


# --- 6: SentencePiece ----------------------------------------------------------


def piece_model() -> bytes:
    import public_tokenizers

    from burnish.llm.sentencepiece_bpe import model_bytes

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@register("op6_sentencepiece")
def _(spark, sf):
    from burnish.llm.sentencepiece_bpe import digests

    return digests(read(spark, sf, "documents"), piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# --- 7: HTML extraction --------------------------------------------------------


@register("op7_html_text")
def _(spark, sf):
    from burnish.llm.html_text import main_text

    return main_text(read(spark, sf, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# --- 8: WARC archives ----------------------------------------------------------

BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * c + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)"
    for c in range(8)
    for s in (15, 10, 5, 0)
)


@register(
    "op8_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM k""",
)
def _(spark, sf):
    from burnish.llm.warc import read_archives, resolve_revisits, write_archives
    from burnish.session import scratch_path

    folder = scratch_path(spark, "archives")
    write_archives(read(spark, sf, "pages"), folder, min_payload=0)
    found = resolve_revisits(read_archives(spark, folder))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


# --- 9: approximate nearest neighbours -----------------------------------------


@register("op9_nearest_neighbours")
def _(spark, sf):
    from burnish.llm.ann import nearest

    return nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


# --- 10: suffix-array dedup ----------------------------------------------------


@register("op10_suffix_dedup")
def _(spark, sf):
    from burnish.llm.suffix_dedup import drop_repeated_bytes

    out = drop_repeated_bytes(read(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# --- 11: fill-in-middle --------------------------------------------------------


@register(
    "op11_fill_in_middle",
    """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
 ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:p] || '<S>' || t[q + 1:n] || '<M>' || t[p + 1:q]
 ELSE '<S>' || t[q + 1:n] || '<P>' || t[1:p] || '<M>' || t[p + 1:q] END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
)
def _(spark, sf):
    from burnish.llm.fill_middle import fill_in_middle, restore

    out = fill_in_middle(read(spark, sf, "documents"))
    return out.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(F.encode("fim_text", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(restore(F.col("fim_text"), F.col("fim_form")), "UTF-8"), 256).alias("restored_sha256"),
    )


# --- 12: Merkle manifest -------------------------------------------------------

#: Levels that the SQL builds in every tree: enough for 16^4 documents a source and 16^4 sources.
SQL_LEVELS = 4


def _merkle_sql() -> str:
    def climb(tree: str, first: str) -> list[str]:
        """Nodes of each level with what stands before and behind them in their run; i is a node's number."""
        steps = [f"{tree}0 AS (SELECT tree, i, n, h FROM {first})"]
        run = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(SQL_LEVELS):
            steps.append(
                f"{tree}_at{k} AS (SELECT tree, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS low,"
                f" coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS high FROM {tree}{k})"
            )
            steps.append(
                f"{tree}{k + 1} AS (SELECT tree, i // 16 AS i, (any_value(n) + 15) // 16 AS n,"
                f" CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {tree}{k} GROUP BY tree, i // 16)"
            )
        return steps

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    bits = "flatten([[(ascii(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')])::BIGINT[]"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384), 4294967295::BIGINT), 4294967295)"
    steps = [
        f"l AS (SELECT doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf('low_text')} ELSE {leaf('text')} END AS tried,"
        " dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,"
        f" count(*) OVER (PARTITION BY source) AS n FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low_text FROM documents))",
        "first AS (SELECT tree, i, n, leaf AS h FROM l)",
        *climb("d", "first"),
        f"second AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM d{SQL_LEVELS})",
        *climb("s", "second"),
        "f0 AS (SELECT doc_id, leaf, tree, i, tried AS fold, '' AS proof FROM l)",
    ]
    k = 0
    for tree, of, number in (("d", "tree", "i"), ("s", "0", "tree")):
        for level in range(SQL_LEVELS):
            k += 1
            steps.append(
                f"f{k} AS (SELECT f.doc_id, f.leaf, f.tree, f.i, CASE WHEN a.n > 1 THEN sha256(a.low || f.fold || a.high) ELSE f.fold END AS fold,"
                f" f.proof || a.low || a.high AS proof FROM f{k - 1} f JOIN {tree}_at{level} a ON a.tree = f.{of} AND a.i = f.{number} // {16**level})"
                if of != "0"
                else f"f{k} AS (SELECT f.doc_id, f.leaf, f.tree, f.i, CASE WHEN a.n > 1 THEN sha256(a.low || f.fold || a.high) ELSE f.fold END AS fold,"
                f" f.proof || a.low || a.high AS proof FROM f{k - 1} f JOIN {tree}_at{level} a ON a.i = f.{number} // {16**level})"
            )
    return (
        f"WITH {', '.join(steps)} SELECT f.doc_id, f.leaf, d.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256,"
        f" f.fold AS folded_root, f.fold = r.h AS verified FROM f{k} f JOIN d{SQL_LEVELS} d ON d.tree = f.tree CROSS JOIN s{SQL_LEVELS} r"
    )


@register("op12_merkle_manifest", _merkle_sql())
def _(spark, sf):
    from burnish.llm.manifest import merkle_manifest

    return merkle_manifest(read(spark, sf, "documents"), tampered=F.expr(f"{REMAINDER} = 0"))


# --- 13: chat formatting -------------------------------------------------------

#: A conversation whose texts look like the template's marks: what both of its turns say.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"


@register(
    "op13_chat_format",
    f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT {TRICKY_ID}, i, r, '{TRICKY_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t') AS esc,
 CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || role END AS label FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('### ' || label || ': ' || esc || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
 regexp_full_match(string_agg(role[1], '' ORDER BY turn, role, text), '(s?(ua)*u?)?') AS in_order FROM e GROUP BY conv_id""",
)
def _(spark, sf):
    from burnish.llm.chat import format_conversations, learned_text, turns_of

    both = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    tricky = spark.range(1).select(F.explode(both).alias("x")).select(
        F.lit(TRICKY_ID).cast("bigint").alias("conv_id"), "x.turn", "x.role", F.lit(TRICKY_TEXT).alias("text")
    )
    turns = read(spark, sf, "conversations").select(*tricky.columns).unionByName(tricky)
    out = format_conversations(turns)
    said = F.transform("_turns", lambda t: F.concat(F.coalesce(t.role, F.lit("")), F.lit("\n"), t.text, F.lit("\n")))
    back = out.select("*", turns_of(F.col("formatted")).alias("_turns"), learned_text(F.col("segments")).alias("_learned"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        sha(F.array_join(said, "")).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"),
        sha(F.col("_learned")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("bad_turn").isNull().alias("in_order"),
    )


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in REGISTRY.items() if e.sql}
