"""Queries over the text functions and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t

Q: dict = {}
SQL: dict[str, str] = {}


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _arguments():
    """A call's arguments, with the text in a deep object and in a list."""
    text = F.struct(F.col("text"))
    return t.shrunk_json(F.to_json(F.struct(F.col("source").alias("kept"), F.struct(F.struct(F.col("text")).alias("deep"), F.array(F.struct(F.lit("a").alias("text")), text).alias("list")).alias("more"))))


def _skill(field):
    """A field of documents as skills: with metadata, with lists by lines, without a description."""
    k = F.col("doc_id") % 3
    head = F.concat(F.lit("---\nname: 'skill "), F.col("doc_id").cast("string"), F.lit("'\n# a remark\n"), F.when(k > 0, F.concat(F.lit("description: Reads: "), "source", F.lit("\n"))).otherwise("description:\n"))
    tools = F.when(k == 2, F.concat(F.lit("allowed-tools:\n  - read\n  - "), "lang", F.lit("\n"))).otherwise(F.concat(F.lit("allowed-tools: read "), "lang", F.lit("\n")))
    more = F.when(k == 1, F.concat(F.lit("metadata:\n  display_name: The "), "lang", F.lit("\n  tags: [a, "), "source", F.lit("]\n"))).when(k == 2, F.lit('metadata:\n  tags:\n    - x\n    - "y z"\n')).otherwise("")
    return t.front_matter(F.concat(head, tools, more, F.lit("---\n"), "text"))[field]


def _captioned():
    k = F.col("doc_id") % 5
    return F.concat(F.when(k == 0, " Figure 3: ").when(k == 1, "FIG.12").when(k == 2, "tables 4").when(k == 3, "图 1：").otherwise(""), F.col("text"))


def _add(name, sql, table="documents", key="doc_id", **columns):
    def run(spark, sf_dir):
        made = {c: f() for c, f in columns.items()}
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, *[c.alias(n) for n, c in made.items()])

    Q[name], SQL[name] = run, sql


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _redact_sql() -> str:
    """The patterns one after the other; RE2 has no lookaround, so digits' neighbours are captured, twice, as neighbouring hits share one."""
    out = "text"
    for p, by in t.REDACTIONS:
        by = by.replace("$1", r"\1")
        times = 1
        if p.startswith(r"(?<!\d)"):
            core = p.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
            p, by, times = rf"(^|[^0-9])(?:{core})($|[^0-9])", rf"\1{by}\2", 2
        for _ in range(times):
            out = f"regexp_replace({out}, {_quoted(p)}, {_quoted(by)}, 'g')"
    return out


#: Numbers behind each text, as documents hold few: phones side by side, an identity number, a card, and longer ones that stay.
PLANTED = " 13812345678 13912345678,138123456789 11010119900307123X 6222021234567890123 62220212345678901234567"
_col = lambda: F.col("text")
_add("txt_redact", f"SELECT doc_id, {_redact_sql()} AS redacted FROM (SELECT doc_id, text || {_quoted(PLANTED)} AS text FROM documents)", redacted=lambda: t.redact(F.concat(_col(), F.lit(PLANTED))))
_add(
    "txt_threats",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN '{n}' END" for p, n in t.THREATS) + f", CASE WHEN regexp_matches(text, '{t.INVISIBLE}') THEN 'invisible_unicode' END], lambda x: x IS NOT NULL), ',') AS threats FROM documents",
    threats=lambda: F.array_join(t.threats(_col()), ","),
)
_add(
    "txt_skill_rules",
    "SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(text, {_quoted(p)}))" for p, _ in t.SKILL_RULES) + " AS n_matches, " + " + ".join(f"regexp_matches(text, {_quoted(p)})::INT" for p, _ in t.SKILL_RULES) + " = 0 AS passed FROM documents",
    n_matches=lambda: F.aggregate(t.skill_matches(_col()), F.lit(0).cast("long"), lambda a, x: a + x["n"]),
    passed=lambda: F.size(t.skill_matches(_col())) == 0,
)
_TRIM = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def _drop(parts, x):
    for p in parts:
        x = f"replace({x}, {_quoted(p)}, '')"
    return x


_add("txt_sanitize_prompt", "SELECT doc_id, " + _TRIM.format(r"regexp_replace(" + _drop(t.STRUCTURE_TAGS, "'## ' || text") + r", '(?m)^[ \t]*#{1,6}[ \t]+', '', 'g')") + " AS clean FROM documents", clean=lambda: t.sanitize_prompt(F.concat(F.lit("## "), _col())))
_add("txt_snippet", "SELECT doc_id, substr(" + _TRIM.format(_drop(t.STRUCTURE_TAGS, "text")) + ", 1, 800) AS snippet FROM documents", snippet=lambda: t.sanitize_retrieved(_col()))
_add("txt_strip_markers", "SELECT doc_id, " + _TRIM.format(_drop(t.MARKERS, "'[INST] ' || text || ' [/INST]'")) + " AS clean FROM documents", clean=lambda: t.strip_markers(F.concat(F.lit("[INST] "), _col(), F.lit(" [/INST]"))))
_add("txt_strip_ansi", f"SELECT doc_id, regexp_replace(chr(27) || '[1m' || text || chr(27) || '[0m', '{t.ANSI}', '', 'g') AS clean FROM documents", clean=lambda: t.strip_ansi(F.concat(F.lit("\x1b[1m"), _col(), F.lit("\x1b[0m"))))
_add("txt_position_tags", r"SELECT doc_id, regexp_replace('@@1' || chr(9) || '52.5##' || text, '@@[\t0-9.-]+?##', '', 'g') AS clean FROM documents", clean=lambda: t.strip_position_tags(F.concat(F.lit("@@1\t52.5##"), _col())))
_add("txt_escape_search", f"SELECT doc_id, regexp_replace(text, {_quoted('(' + t.SEARCH_SPECIAL + ')')}, '\\\\\\1', 'g') AS escaped FROM documents", escaped=lambda: t.escape_search(_col()))
_add("txt_token_count", f"SELECT doc_id, len(regexp_extract_all(text, '{t.TOKEN}')) AS n_tokens FROM documents", n_tokens=lambda: F.size(t.tokens(_col())).cast("long"))
_add("txt_half_width", f"SELECT doc_id, translate(text || '！Ａ', {_quoted(t.FULL_WIDTH)}, {_quoted(t.HALF_WIDTH)}) AS narrow FROM documents", narrow=lambda: t.half_width(F.concat(_col(), F.lit("！Ａ"))))
_add("txt_garbled", f"SELECT doc_id, round(len(regexp_extract_all(text, '{t.GARBLED}')) / length(text), 6) AS ratio, len(regexp_extract_all(text, '{t.GARBLED}')) / length(text) >= 0.3 AS garbled FROM documents", ratio=lambda: F.round(t.garbled_ratio(_col()), 6), garbled=lambda: t.garbled_ratio(_col()) >= 0.3)
_add("txt_dirty", r"SELECT doc_id, regexp_matches(text, '\(cid\s*:\s*\d+\s*\)|[\x{E000}-\x{F8FF}]') AS dirty FROM documents", dirty=lambda: t.dirty(_col()))
_add("txt_hashes", "SELECT doc_id, sha256(text) AS content_hash, md5(text) AS search_key, substr(md5(text), 1, 12) AS short_key FROM documents", content_hash=lambda: F.sha2(_col(), 256), search_key=lambda: F.md5(_col()), short_key=lambda: F.substring(F.md5(_col()), 1, 12))
_add("txt_like_escaped", "SELECT doc_id, contains(lower(text), '50%_off') AS percent, contains(lower(text), 'license') AS license FROM documents", percent=lambda: t.like_escaped(_col(), "50%_off"), license=lambda: t.like_escaped(_col(), "License"))
_add("txt_fulltext_token", "SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 _.-]', '', 'g') AS clean FROM documents", clean=lambda: F.regexp_replace(_col(), "[^A-Za-z0-9 _.-]", ""))
_add(
    "txt_anchors",
    r"""SELECT doc_id, printf('[%02d:%02d:%02d#%d]', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60, doc_id) AS anchor,
  array_to_string(regexp_extract_all('[00:00:15#3] a [00:01:00#12] b', '\[\d{2}:\d{2}:\d{2}#(\d+)\]', 1), ',') AS found, regexp_replace('[00:00:15#3] a [00:01:00#12] b', '\[\d{2}:\d{2}:\d{2}#\d+\]\s*', '', 'g') AS plain FROM documents""",
    anchor=lambda: t.anchor(F.col("n_chars"), F.col("doc_id")),
    found=lambda: F.array_join(t.anchor_indices(F.lit("[00:00:15#3] a [00:01:00#12] b")).cast("array<string>"), ","),
    plain=lambda: t.strip_anchors(F.lit("[00:00:15#3] a [00:01:00#12] b")),
)
_add("txt_head_tail", r"SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 3000) || e'\n...\n' || right(text, 800) ELSE text END AS short FROM documents", short=lambda: t.head_tail(_col()))
_add(
    "txt_captions",
    r"""WITH b AS (SELECT doc_id, regexp_replace(CASE doc_id % 5 WHEN 0 THEN ' Figure 3: ' WHEN 1 THEN 'FIG.12' WHEN 2 THEN 'tables 4' WHEN 3 THEN '图 1：' ELSE '' END || text, '^\s+|\s+$', '', 'g') AS x FROM documents) SELECT doc_id, regexp_matches(x, '^(?i:fig(ure)?)\.?\s*\d+') OR regexp_matches(x, '^(?i:table)\s+\d+') OR regexp_matches(x, '^[图表][ 0-9:：]{2,}') AS caption, doc_id % 7 = 0 OR regexp_matches(x, '^(?i:fig(ure)?)\.?\s*\d+') OR regexp_matches(x, '^(?i:table)\s+\d+') OR regexp_matches(x, '^[图表][ 0-9:：]{2,}') AS by_region FROM b""",
    caption=lambda: t.is_caption(_captioned()),
    by_region=lambda: t.is_caption(_captioned(), F.when(F.col("doc_id") % 7 == 0, "table caption")),
)
_add(
    "txt_subset_fonts",
    """WITH w AS (SELECT doc_id, (string_split(text, ' '))[1:200] AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: length(x) % 2 = 0 AND length(x) > 0 AND strlen(x) = length(x))) / len(w) >= 0.5 AS unreadable FROM w""",
    unreadable=lambda: t.subset_fonts(F.transform(F.split("text", " "), lambda x: F.struct(x.alias("text"), F.when(F.length(x) % 2 == 0, "ABCDEF+Times").otherwise("Times").alias("font")))),
)
_add(
    "txt_front_matter",
    r"""WITH x AS (SELECT doc_id, lang, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, doc_id % 3 > 0 AS ok FROM documents)
SELECT doc_id, ok AS valid, 'skill ' || doc_id AS skill, CASE WHEN ok THEN 'Reads: ' || source END AS description, CASE doc_id % 3 WHEN 1 THEN 'The ' || lang ELSE 'skill ' || doc_id END AS shown, 'read|' || lang AS tools, CASE doc_id % 3 WHEN 1 THEN 'a|' || source WHEN 2 THEN 'x|y z' END AS tags, md5(body) AS body FROM x""",
    valid=lambda: _skill("valid"),
    skill=lambda: _skill("name"),
    description=lambda: _skill("description"),
    shown=lambda: _skill("display_name"),
    tools=lambda: F.array_join(_skill("allowed_tools"), "|"),
    tags=lambda: F.array_join(_skill("tags"), "|"),
    body=lambda: F.md5(_skill("body")),
)
_add(
    "txt_shrunk_arguments",
    """SELECT doc_id, source AS kept, x AS deep, x AS listed, left(text, 200) || '...[truncated]' AS broken FROM (SELECT *, CASE WHEN length(text) > 200 THEN left(text, 200) || '...[truncated]' ELSE text END AS x FROM documents)""",
    kept=lambda: F.get_json_object(_arguments(), "$.kept"),
    deep=lambda: F.get_json_object(_arguments(), "$.more.deep.text"),
    listed=lambda: F.get_json_object(_arguments(), "$.more.list[1].text"),
    broken=lambda: t.shrunk_json(_col()),
)
_add("txt_whitespace_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::INT AS n FROM documents", n=lambda: t.whitespace_tokens(_col()))
_add("txt_scrub_tags", r"SELECT conv_id, turn, regexp_replace('<think>x</think>' || text, '(?s)<think>.*?</think>|<memory-context>.*?</memory-context>|<documents>.*?</documents>', '', 'g') AS clean FROM conversations", table="conversations", key="conv_id", turn=lambda: F.col("turn"), clean=lambda: t.scrub_tags(F.concat(F.lit("<think>x</think>"), _col())))


def txt_token_tags(spark, sf_dir):
    token = _docs(spark, sf_dir).select(F.explode(t.tokens(_col())).alias("token"))
    return token.groupBy(t.token_tag(F.col("token")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct"))


Q["txt_token_tags"] = txt_token_tags
SQL["txt_token_tags"] = f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '{t.TOKEN}')) AS token FROM documents)
SELECT CASE WHEN regexp_matches(token, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'n' WHEN regexp_matches(token, '^[A-Z][a-z]+$') THEN 'nr' WHEN regexp_matches(token, '^[A-Za-z]+$') THEN 'en' WHEN regexp_matches(token, '^[0-9]+$') THEN 'm' ELSE 'x' END AS tag,
  count(*) AS n, count(DISTINCT token) AS n_distinct FROM w GROUP BY 1"""


def txt_cell_kinds(spark, sf_dir):
    cell = _docs(spark, sf_dir).select(F.explode(F.split("text", r"[|\n]")).alias("cell"))
    return cell.groupBy(t.cell_kind(F.col("cell")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


Q["txt_cell_kinds"] = txt_cell_kinds
SQL["txt_cell_kinds"] = (
    "WITH c AS (SELECT trim(unnest(string_split_regex(text, '[|\\n]'))) AS x FROM documents), k AS (SELECT x, list_filter(regexp_extract_all(x, '" + t.TOKEN + "'), lambda y: length(y) > 1) AS w FROM c) SELECT CASE "
    + " ".join(f"WHEN regexp_matches(x, {_quoted(p)}) THEN '{k}'" for p, k in t.CELL_KINDS)
    + " WHEN len(w) > 3 AND len(w) < 12 THEN 'Tx' WHEN len(w) >= 12 THEN 'Lx' WHEN len(w) = 1 AND regexp_matches(w[1], '^[A-Z][a-z]+$') THEN 'Nr' ELSE 'Ot' END AS kind, count(*) AS n FROM k GROUP BY 1"
)


def txt_usage(spark, sf_dir):
    """Token usage in three providers' shapes, normalised."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", k.alias("k")).select(
        "event_id",
        F.when(F.col("k") % 3 == 0, F.format_string('{"total_tokens":%d}', "k"))
        .when(F.col("k") % 3 == 1, F.format_string('{"input_tokens":%d,"output_tokens":20,"cache_read_input_tokens":5}', "k"))
        .otherwise(F.format_string('{"prompt_tokens":%d,"completion_tokens":50,"prompt_tokens_details":{"cached_tokens":1}}', "k"))
        .alias("raw"),
    )
    return raw.select("event_id", usage(F.col("raw")).alias("u")).select("event_id", "u.*")


def usage(raw):
    """Structs (input_tokens, output_tokens, cache_read_tokens) from raw usage JSON; prompt tokens include the cached ones."""
    n = lambda path: F.get_json_object(raw, path).cast("long")
    zero = F.lit(0).cast("long")
    cached = F.coalesce(n("$.cache_read_input_tokens"), n("$.prompt_tokens_details.cached_tokens"), zero)
    prompt, given = n("$.prompt_tokens"), n("$.input_tokens")
    outgoing = F.coalesce(n("$.output_tokens"), n("$.completion_tokens"))
    only_total = given.isNull() & prompt.isNull() & outgoing.isNull()
    return F.struct(
        F.coalesce(given, F.greatest(prompt - cached, zero), zero).alias("input_tokens"),
        F.when(only_total, F.coalesce(n("$.total_tokens"), zero)).otherwise(F.coalesce(outgoing, zero)).alias("output_tokens"),
        cached.alias("cache_read_tokens"),
    )


Q["txt_usage"] = txt_usage
SQL["txt_usage"] = """WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN k ELSE greatest(k - 1, 0) END AS input_tokens,
  CASE WHEN k % 3 = 0 THEN k WHEN k % 3 = 1 THEN 20 ELSE 50 END::BIGINT AS output_tokens,
  CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 5 ELSE 1 END::BIGINT AS cache_read_tokens FROM e"""
