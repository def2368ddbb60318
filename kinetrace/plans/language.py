"""Queries over ``documents``, ``conversations`` and ``events.props``: text rules, dialogue memory, payload checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrace.functions import protocol, text
from kinetrace.operators import dialogue
from kinetrace.session import table


def language_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_language(F.coalesce("text", F.lit(""))).alias("route"), text.language_tag(F.col("lang")).alias("tag"))


def keyword_flags(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.about_motion(t).alias("motion"), text.is_goodbye(t).alias("goodbye"), text.prompt_direction(t).alias("direction"))


def text_speakable(spark, sf_dir):
    """Whole texts without what a voice should not read, as length and digest."""
    s = text.speakable(F.coalesce("text", F.lit("")), references=True)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


def text_corrections(spark, sf_dir):
    s = text.correct(F.coalesce("text", F.lit("")), {"the": "this", "this ": "that ", "of": "from"})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(s).alias("digest"), text.shorten(F.col("text"), 24).alias("start"))


def plain_requests(spark, sf_dir):
    s = text.plain_request(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(s).alias("digest"))


def _places(rows, *keys):
    """A row for each phrase of ``p``; an inner explode would compute it again to filter rows that have none."""
    return rows.select(*keys, F.posexplode_outer("p").alias("place", "phrase")).filter(F.col("phrase").isNotNull())


def segment_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.phrases(F.coalesce("text", F.lit(""))).alias("p"))
    return _places(rows, "doc_id")


def segment_replies(spark, sf_dir):
    """The phrases of what is said in conversations, in their order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.phrases(F.coalesce("text", F.lit(""))).alias("p"))
    return _places(rows, "conv_id", "turn")


def speakable_documents(spark, sf_dir):
    """Whole documents as they are read out, without a step outside the JVM."""
    s = text.speakable(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


def intents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.motion_command(F.coalesce("text", F.lit(""))).alias("command"))


def transcripts(spark, sf_dir):
    payload = F.concat(F.lit('{"segments": [{"no_speech_prob": 0.'), F.col("turn"), F.lit(', "avg_logprob": -1.2, "compression_ratio": 1.5}]}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.invented(F.coalesce("text", F.lit("")), payload, F.col("turn") * 0.5).alias("invented"))


def memory_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return dialogue.trim_memory(rows, ["conv_id"], ["turn"], "text", 2, 900).select("conv_id", "turn", "role")


def newest_of_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))


def payload_numbers(spark, sf_dir):
    errors = protocol.key_errors(F.col("props"), ["k", "m"])
    return table(spark, sf_dir, "events").select("event_id", protocol.number_of(F.col("props"), "k").alias("k"), F.array_join(errors["missing"], ",").alias("missing"), F.array_join(errors["extra"], ",").alias("extra"))


def payload_ranges(spark, sf_dir):
    k = protocol.number_of(F.col("props"), "k")
    bad = protocol.range_errors({"s": k, "d": k - 40, "reserve": k / 2, "horizon": F.lit(50)}, protocol.SCHEDULE_RANGES)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(bad, ",").alias("bad"))


def payload_flattened(spark, sf_dir):
    made = F.concat(F.lit('{"arm": ['), F.col("value"), F.lit(", "), F.col("event_id"), F.lit('], "grip": ['), F.when(F.col("event_id") % 5 == 0, "true").otherwise("0.5"), F.lit("]}"))
    flat = protocol.flatten_action(made, {"arm": 2, "grip": 1})
    return table(spark, sf_dir, "events").select("event_id", F.size(F.coalesce(flat, F.array().cast("array<double>"))).alias("n"), F.get(flat, F.lit(0)).alias("first"))


QUERIES = {f.__name__: f for f in (
    language_route, keyword_flags, text_speakable, text_corrections, plain_requests, segment_text, segment_replies, speakable_documents, intents, transcripts, memory_trim, newest_of_role,
    payload_numbers, payload_ranges, payload_flattened,
)}

QUOTED = text.PUNCTUATION.replace("'", "''")
SPACES = r"[\s\x{3000}\x{00a0}\x{0085}]"
HINTS = "[" + ", ".join("'" + h + "'" for h in text.HINTS) + "]"
C = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, text FROM conversations)"
PLAIN = f"trim(translate(regexp_replace(replace(lower(trim(t, chr(9) || chr(10) || chr(13) || ' ')), '{text.NAME}', ''), '{SPACES}+', ' ', 'g'), '{QUOTED}', ''))"
BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _speakable_sql(x: str) -> str:
    """``text.speakable`` without character references, of which the conversations have none."""
    amount = r"(\d+(?:\.\d+)?)"
    rules = [
        (rf"(?s)```[\p{{L}}\p{{N}}_]*[{BLANK}]*(.*?)```", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"`([^`]+)`", r"\1"), (rf"(?i)https?://[^{BLANK}]+|www\.[^{BLANK}]+", "链接"),
        (r"\b(20\d{2})[-/.](?:0(\d)|([1-9]\d?|0))[-/.](?:0(\d)|([1-9]\d?|0))\b", r"\1年\2\3月\4\5日"), (rf"[￥¥][{BLANK}]*{amount}", r"\1元"), (rf"\$[{BLANK}]*{amount}", r"\1美元"), (rf"{amount}[{BLANK}]*%", r"百分之\1"),
    ]
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for a, b in [*text.UNITS.items(), *text.MARKS.items()]:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[{BLANK}]+', ' ', 'g'))"


PHRASE_END = f"list_min(list_filter(range(1, least(81, len(rest) + 1)), lambda i: CASE WHEN contains('{text.HARD.strip()}', rest[i]) THEN i >= 15 WHEN contains('{text.SOFT}', rest[i]) THEN i >= 40 ELSE i >= 80 END))"
_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_any = lambda x, words: f"len(list_filter({_list(words)}, lambda w: contains({x}, w))) > 0"


def _phrases_sql(keys: str, texts: str) -> str:
    """``text.phrases`` of the rows (keys, rest) of a query."""
    over = f"OVER (PARTITION BY {keys} ORDER BY k)"
    return f"""s AS ({texts}), e AS (SELECT {keys}, rest, {PHRASE_END} AS e, 0 AS k FROM s),
r AS (SELECT {keys}, rest, e, k FROM e UNION ALL SELECT {keys}, n AS rest, {PHRASE_END.replace('rest', 'n')} AS e, k + 1 FROM (SELECT {keys}, rest[e + 1:] AS n, k FROM r WHERE e IS NOT NULL)),
p AS (SELECT {keys}, k, e IS NULL AS last, trim(CASE WHEN e IS NULL THEN rest ELSE rest[1:e] END) AS p FROM r), q AS (SELECT *, lag(p) {over} AS before, lead(p) {over} AS after, lead(last) {over} AS then_last FROM p),
j AS (SELECT *, coalesce(last AND p <> '' AND length(p) < 15 AND length(before) + length(p) <= 80, false) AS gone, coalesce(then_last AND after <> '' AND length(after) < 15 AND length(p) + length(after) <= 80, false) AS grows FROM q),
f AS (SELECT {keys}, k, CASE WHEN grows THEN p || after ELSE p END AS phrase FROM j WHERE NOT gone)
SELECT {keys}, (row_number() {over} - 1)::INT AS place, phrase FROM f WHERE phrase <> ''"""


ORACLES = {
    "text_speakable": f"WITH {C}, s AS (SELECT conv_id, turn, {_speakable_sql('t')} AS s FROM c) SELECT conv_id, turn, length(s) AS n, md5(s) AS digest FROM s",
    "speakable_documents": f"WITH s AS (SELECT doc_id, {_speakable_sql("coalesce(text, '')")} AS s FROM documents) SELECT doc_id, length(s) AS n, md5(s) AS digest FROM s",
    "segment_replies": f"WITH RECURSIVE {C}, " + _phrases_sql("conv_id, turn", f"SELECT conv_id, turn, {_speakable_sql('t')} AS rest FROM c"),
    "segment_text": "WITH RECURSIVE " + _phrases_sql("doc_id", f"SELECT doc_id, {_speakable_sql("replace(coalesce(text, ''), '&amp;', '&')")} AS rest FROM documents"),
    "intents": f"""WITH RECURSIVE {C}, a AS (SELECT conv_id, turn, {PLAIN} AS p FROM c), v AS (SELECT conv_id, turn, unnest([p, replace(p, ' ', '')]) AS v FROM a UNION
  SELECT conv_id, turn, trim(n) FROM (SELECT conv_id, turn, unnest(list_concat(list_transform(list_filter({_list(text.POLITE_BEFORE)}, lambda w: starts_with(v, w)), lambda w: v[length(w) + 1:]),
    list_transform(list_filter({_list(text.POLITE_AFTER)}, lambda w: ends_with(v, w)), lambda w: v[:length(v) - length(w)]))) AS n FROM v) WHERE trim(n) <> ''),
l AS (SELECT conv_id, turn, list(DISTINCT v) AS vs FROM v GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN p = '' THEN NULL WHEN {_any("p", text.NEGATIONS)} AND {_any("p", text.HINTS)} THEN 'stop' {" ".join(f"WHEN list_has_any(vs, {_list(w)}) THEN '{k}'" for k, w in text.COMMANDS.items())} END AS command FROM a JOIN l USING (conv_id, turn)""",
    "language_route": r"""WITH n AS (SELECT doc_id, lang, len(regexp_extract_all(coalesce(text, ''), '[\x{3400}-\x{9fff}]')) AS h, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, CASE WHEN h > 0 AND h >= greatest(1, l // 3) THEN 'zh' ELSE 'en' END AS route, CASE WHEN coalesce(lang, '') = '' OR split_part(replace(lower(trim(lang)), '_', '-'), '-', 1) = 'zh' THEN 'zh' WHEN split_part(replace(lower(trim(lang)), '_', '-'), '-', 1) = 'en' THEN 'en' END AS tag FROM n""",
    "keyword_flags": f"""WITH {C}, p AS (SELECT conv_id, turn, t, {PLAIN} AS p, list_distinct(list_transform(regexp_extract_all(t, '(?i)\\b(left|right)\\b'), lambda x: lower(x))) AS d FROM c)
SELECT conv_id, turn, len(list_filter({HINTS}, lambda h: contains(p, h))) > 0 AS motion, len(list_filter({list(text.GOODBYES)}, lambda g: contains(lower(regexp_replace(t, '[\\s\\x{{3000}}，。！？,.!?]', '', 'g')), g))) > 0 AS goodbye, CASE WHEN len(d) = 1 THEN d[1] END AS direction FROM p""",
    "text_corrections": f"WITH {C} SELECT conv_id, turn, md5(replace(replace(replace(t, 'the', 'this'), 'this ', 'that '), 'of', 'from')) AS digest, text[1:24] AS start FROM c",
    "plain_requests": f"WITH {C} SELECT conv_id, turn, md5({PLAIN}) AS digest FROM c",
    "transcripts": f"""WITH {C} SELECT conv_id, turn, t <> '' AND (turn * 0.5 < 1.0 AND len(regexp_replace(t, '[\\s\\x{{3000}}，。！？,.!?]', '', 'g')) > 18 OR ('0.' || turn)::DOUBLE > 0.7) AS invented FROM c""",
    "memory_trim": f"""WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM c WHERE regexp_matches(t, '\\S'))
SELECT conv_id, turn, role FROM r WHERE k <= 4 AND (s <= 900 OR k <= 2)""",
    "newest_of_role": "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "payload_numbers": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(props, '$.k')::DOUBLE END AS k, 'm' AS missing, '' AS extra FROM events",
    "payload_ranges": """WITH p AS (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN k BETWEEN 1 AND 49 THEN NULL ELSE 's' END, CASE WHEN k - 40 BETWEEN 0 AND 49 THEN NULL ELSE 'd' END, CASE WHEN k / 2 BETWEEN 0 AND 49 THEN NULL ELSE 'reserve' END], lambda x: x IS NOT NULL), ',') AS bad FROM p""",
    "payload_flattened": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN event_id % 5 <> 0 THEN value END AS first FROM events",
}
