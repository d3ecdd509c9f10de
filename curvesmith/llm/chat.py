"""Chat formatting: tool calls linked to their results, ordered, validated and serialised, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Argument types of a schema and what schema_of_variant() calls values of them.
TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT<.*$", "array": r"^ARRAY<.*$", "null": r"^VOID$"}
#: A plain exchange is a call of this tool: what a user says is answered by the turn after it.
REPLY = "reply"
SCHEMAS = {
    REPLY: {
        "required": ["text", "words"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 100_000}, "words": {"type": "integer", "minimum": 1}},
    },
}


def canonical(json: Column) -> Column:
    """Canonical JSON: keys sorted, no white space, numbers in one form. Null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(args: Column, schema: dict) -> Column:
    """Array of what is wrong with an arguments' variant under a schema (required, properties with type, minLength,
    maxLength, pattern, minimum, maximum, enum; additionalProperties)."""
    out: list[Column] = []
    note = lambda bad, text: F.when(bad, F.lit(text))
    kind = F.schema_of_variant(args)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    out.append(note(~is_object, "not an object"))
    keys = F.when(is_object, F.json_object_keys(F.to_json(args)))
    for name in schema.get("required", []):
        out.append(note(is_object & ~F.coalesce(F.array_contains(keys, name), F.lit(False)), f"{name}: missing"))
    known = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
        out.append(note(is_object & (F.size(extra) > 0), "unknown argument"))
    for name, rule in known.items():
        path = "$['" + name.replace("'", "\\'") + "']"
        has = is_object & F.coalesce(F.array_contains(keys, name), F.lit(False))
        value = F.try_variant_get(args, path, "variant")
        text, number = F.try_variant_get(args, path, "string"), F.try_variant_get(args, path, "double")
        if "type" in rule:
            fits = F.coalesce(F.schema_of_variant(value).rlike(TYPES[rule["type"]]), F.lit(False))
            out.append(note(has & ~fits, f"{name}: not {rule['type']}"))
            has = has & fits
        checks = {
            "minLength": lambda x: F.length(text) < x, "maxLength": lambda x: F.length(text) > x, "pattern": lambda x: ~text.rlike(x),
            "minimum": lambda x: number < x, "maximum": lambda x: number > x, "enum": lambda x: ~text.isin(*map(str, x)),
        }
        out += [note(has & F.coalesce(check(rule[c]), F.lit(False)), f"{name}: {c}") for c, check in checks.items() if c in rule]
    return F.array_compact(F.array(*out))


def validated(calls: DataFrame, schemas: dict) -> DataFrame:
    """Adds valid and errors (array) to calls (…, tool, args): args is a JSON text. Without a tool, args may be a whole
    message whose calls could not be read."""
    calls = calls.withColumn("_v", F.try_parse_json("args"))
    found = F.when(F.col("_v").isNull(), F.array(F.lit("not JSON")))
    nameless = F.col("tool").isNull() & F.col("args").isNotNull()
    not_calls = F.coalesce(F.try_variant_get("_v", "$.tool_calls", "variant").isNotNull(), F.lit(False))
    known = F.lit(False)
    for name, schema in schemas.items():
        found = found.when(F.col("tool") == name, problems(F.col("_v"), schema))
        known = known | (F.col("tool") == name)
    unread = F.when(nameless & F.col("_v").isNull(), F.array(F.lit("not JSON"))).when(nameless & not_calls, F.array(F.lit("tool_calls: not array")))
    found = unread.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool"))).otherwise(found)
    return calls.withColumn("errors", found).withColumn("valid", F.size("errors") == 0).drop("_v")


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the length of the longest chain of calls that a call waits for, so (level, turn) is a
    topological order. calls: distinct (conv_id, call_id); needs: (conv_id, call_id, dep). Calls on a cycle, or behind
    one, have a null level.

    Calls that wait for one other form chains; their distance to the head of the chain is found by doubling, in as many
    rounds as the logarithm of the longest chain. Only calls that wait for several are then ordered level by level, on
    what is left: heads of chains and distances.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key)
    edges = needs.join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi").join(nodes, key, "left_semi")
    edges = cut(edges.select("conv_id", "call_id", "dep").distinct())
    counts = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    chain = cut(counts.filter("n = 1").select(*key, F.col("dep").alias("head"), F.lit(1).cast("long").alias("far")))
    most = chain.count()
    for _ in range(max(1, most).bit_length() + 1):
        hop = chain.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        step = cut(chain.join(hop, ["conv_id", "head"], "left"))
        chain = step.select(*key, F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        if step.filter("next is not null").isEmpty():
            break
    # heads that are themselves in a chain, after all these rounds, are on a cycle
    ends = chain.join(chain.select("conv_id", F.col("call_id").alias("head")), ["conv_id", "head"], "left_anti").select(*key, "head", "far")
    ends = cut(ends)
    roots = cut(nodes.join(counts.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    joint = edges.join(counts.filter("n > 1").select(*key), key, "left_semi")
    to = ends.select("conv_id", F.col("call_id").alias("dep"), "head", "far")
    stuck = counts.filter("n = 1").select(*key).join(ends, key, "left_anti").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("stuck"))
    joint = joint.join(to, ["conv_id", "dep"], "left").join(stuck, ["conv_id", "dep"], "left")
    # a need behind a cycle keeps a head that is never met
    head = F.when(F.col("stuck").isNotNull(), F.lit(None)).otherwise(F.coalesce("head", "dep"))
    left = cut(joint.select(*key, head.alias("head"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(0).cast("long").alias("so_far")))
    front = done = roots
    while not left.isEmpty():
        met = front.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("of_head"))
        marked = cut(left.join(met, ["conv_id", "head"], "left"))
        now = marked.groupBy(*key).agg(F.count_if(F.col("of_head").isNull() & (F.col("so_far") == 0)).alias("n"), F.max(F.greatest("so_far", F.col("of_head") + F.col("far"))).alias("level"))
        front = cut(now.filter("n = 0").select(*key, "level"))
        if front.isEmpty() and marked.filter("of_head is not null").isEmpty():
            break
        known = F.coalesce(F.col("of_head") + F.col("far"), F.col("so_far"))
        left = cut(marked.join(front.select(*key), key, "left_anti").select(*key, F.when(F.col("of_head").isNull(), F.col("head")).alias("head"), "far", known.alias("so_far")))
        done = done.unionByName(front)
    done = cut(done)
    chained = ends.join(done.select("conv_id", F.col("call_id").alias("head"), "level"), ["conv_id", "head"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    have = done.unionByName(chained)
    return nodes.join(have, key, "left").select(*key, F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict) -> DataFrame:
    """calls (conv_id, turn, call_id, tool, args), results (conv_id, turn, call_id, content), needs (conv_id, call_id, dep).

    One row per distinct call and per result without a call: conv_id, turn, call_id, kind ('call' or 'orphan'), tool,
    level, linked, result_turn, n_results, valid, errors, json. Of calls with one id the earliest counts, and of results
    the earliest; ties by tool and arguments, or content. Ids are hash-joined within their conversation; both sides
    have one row per id by then, so no id is hot. Ids are compared as they are; rows without id or conversation are
    not linked, and each is a row of its own. Arguments that are not JSON are `text` in json.
    """
    key = ["conv_id", "call_id"]
    own = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.monotonically_increasing_id())
    calls, results = calls.withColumn("_own", own), results.withColumn("_own", own)
    first = F.min(F.struct("turn", "tool", "args")).alias("c")
    one = cut(calls.groupBy(*key, "_own").agg(first).select(*key, "c.turn", "c.tool", "c.args"))
    answers = results.groupBy(*key, "_own").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answers = cut(answers.drop("_own"))
    order = levels(one, needs)
    full = validated(one, schemas).join(answers.hint("shuffle_hash"), key, "left").join(order.hint("shuffle_hash"), key, "left")
    body = F.to_json(F.struct(
        F.lit("call").alias("kind"), F.col("conv_id").cast("string").alias("conversation"), F.col("call_id").alias("id"), F.col("tool").alias("tool"),
        F.when(F.col("errors").isNull() | ~F.array_contains(F.coalesce("errors", F.array().cast("array<string>")), "not JSON"), F.try_parse_json("args")).alias("arguments"),
        F.when(F.try_parse_json("args").isNull(), F.col("args")).alias("text"),
        F.col("level").alias("level"), F.col("valid").alias("valid"), F.col("errors").alias("errors"), F.col("r.content").alias("result"),
    ))
    done = full.select(
        "conv_id", "turn", "call_id", F.lit("call").alias("kind"), "tool", "level", F.col("r").isNotNull().alias("linked"),
        F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "valid",
        F.array_join("errors", "; ").alias("errors"), canonical(body).alias("json"),
    )
    alone = answers.join(one.select(*key).hint("shuffle_hash"), key, "left_anti")
    body = F.to_json(F.struct(F.lit("orphan").alias("kind"), F.col("conv_id").cast("string").alias("conversation"), F.col("call_id").alias("id"), F.col("r.content").alias("result")))
    none = lambda t: F.lit(None).cast(t)
    left = alone.select(
        "conv_id", F.col("r.turn").alias("turn"), "call_id", F.lit("orphan").alias("kind"), none("string").alias("tool"), none("int").alias("level"),
        F.lit(False).alias("linked"), F.col("r.turn").alias("result_turn"), F.col("n_results").cast("long").alias("n_results"), none("boolean").alias("valid"),
        F.lit("").alias("errors"), canonical(body).alias("json"),
    )
    return done.unionByName(left)


def _messages(messages: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return messages.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def extracted(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and needs in messages.

    Tool calls: a JSON object in an assistant's text, {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}.
    Tool results: a JSON object in a tool's text, {"tool_call_id", "content"}. Plain turns: each user turn is a call of
    `reply` with the id of its place, answered by the assistant's next turn, and waits for the user turn two before.

    A call or result without id gets one of its own from its place and message, which nothing else has. A tool's text
    without content is content as it stands; an assistant's that should hold calls but can't be read is a call without
    a tool, with the text as arguments; without any calls (none, or null) it is said. Other roles: see standing().
    """
    m = _messages(messages, id_col, turn_col, role_col, text_col)
    place = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    said = m.filter("role = 'user'")
    plain = said.select("conv_id", "turn", place(F.col("turn")).alias("call_id"), F.lit(REPLY).alias("tool"), F.to_json(F.struct("text", words.alias("words"))).alias("args"))
    waits = said.select("conv_id", place(F.col("turn")).alias("call_id"), place(F.col("turn") - 2).alias("dep"))
    own = lambda *more: F.concat(place(F.col("turn")), F.lit("#"), *more, F.lower(F.hex(F.xxhash64("text"))))
    v = F.when(F.col("text").startswith("{"), F.try_parse_json("text"))
    spoken = m.filter("role = 'assistant'").withColumn("v", v).withColumn("c", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    given = F.try_variant_get("v", "$.tool_calls", "variant")
    meant = F.col("text").startswith("{") & F.contains("text", F.lit('"tool_calls"'))
    wrong = F.col("c").isNull() & given.isNotNull() & ~F.is_variant_null(given)
    kind = F.when(F.size("c") > 0, F.lit("calls")).when((meant & F.col("v").isNull()) | wrong, F.lit("broken")).otherwise(F.lit("said"))
    spoken = spoken.withColumn("kind", kind)
    listed = spoken.filter("kind = 'calls'").select("conv_id", "turn", "text", F.posexplode("c").alias("k", "c"))
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    ident = F.coalesce(get("$.id", "string"), own(F.col("k").cast("string"), F.lit("-")))
    asked = listed.select("conv_id", "turn", ident.alias("call_id"), get("$.name", "string").alias("tool"), F.to_json(get("$.arguments", "variant")).alias("args"), get("$.after", "array<string>").alias("after"))
    after = asked.select("conv_id", "call_id", F.explode("after").alias("dep"))
    broken = spoken.filter("kind = 'broken'").select("conv_id", "turn", own().alias("call_id"), F.lit(None).cast("string").alias("tool"), F.col("text").alias("args"))
    replies = spoken.filter("kind = 'said'").select("conv_id", "turn", place(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    t = m.filter("role = 'tool'").withColumn("v", F.try_parse_json("text"))
    ident = F.coalesce(F.try_variant_get("v", "$.tool_call_id", "string"), own(F.lit("result-")))
    content = F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant")), F.col("text"))
    tools = t.select("conv_id", "turn", ident.alias("call_id"), content.alias("content"))
    return plain.unionByName(asked.drop("after")).unionByName(broken), replies.unionByName(tools), waits.unionByName(after)


def standing(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages that are neither call nor result, as rows like link()'s: kind 'system', or 'other' for roles unknown here."""
    m = _messages(messages, id_col, turn_col, role_col, text_col).filter("role is null or role not in ('user', 'assistant', 'tool')")
    kind = F.when(F.col("role") == "system", F.lit("system")).otherwise(F.lit("other"))
    body = F.to_json(F.struct(kind.alias("kind"), F.col("conv_id").cast("string").alias("conversation"), F.when(kind == "other", F.col("role")).alias("role"), F.col("text").alias("text")))
    none = lambda t: F.lit(None).cast(t)
    return m.select(
        "conv_id", "turn", F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("call_id"), kind.alias("kind"), none("string").alias("tool"), none("int").alias("level"),
        F.lit(False).alias("linked"), none("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), none("boolean").alias("valid"),
        F.lit("").alias("errors"), canonical(body).alias("json"),
    )


def formatted(messages: DataFrame, schemas: dict) -> DataFrame:
    """Every call, every result without one, and every standing message of messages (conv_id, turn, role, text)."""
    calls, results, needs = extracted(messages)
    return link(calls, results, needs, schemas).unionByName(standing(messages))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call and every result without one of `conversations`, linked, ordered, validated and serialised, and its
    standing messages."""
    return formatted(table(spark, sf_dir, "conversations"), SCHEMAS)


#: For messages that hold no tool calls, as those of `conversations`: exchanges only.
OP3_SQL = r"""
WITH m AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT conv_id, turn, min(text) AS text FROM m WHERE role = 'user' GROUP BY 1, 2),
a AS (SELECT conv_id, turn - 1 AS call, min(text) AS content, count(*) AS n FROM m WHERE role = 'assistant' GROUP BY 1, 2),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM u),
l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1)::INT AS level, len(regexp_extract_all(text, '\S+')) AS words FROM g),
j AS (SELECT l.*, 'turn-' || turn AS call_id, content, n, list_filter([CASE WHEN length(text) < 1 THEN 'text: minLength' END, CASE WHEN length(text) > 100000 THEN 'text: maxLength' END, CASE WHEN words < 1 THEN 'words: minimum' END], lambda x: x IS NOT NULL) AS e
  FROM l LEFT JOIN a ON l.conv_id = a.conv_id AND l.turn = a.call)
SELECT conv_id, turn, call_id, 'call' AS kind, 'reply' AS tool, level, content IS NOT NULL AS linked, CASE WHEN content IS NOT NULL THEN turn + 1 END AS result_turn, coalesce(n, 0) AS n_results,
  len(e) = 0 AS valid, array_to_string(e, '; ') AS errors,
  '{"arguments":{"text":' || to_json(text) || ',"words":' || words || '},"conversation":"' || conv_id || '","errors":' || to_json(e) || ',"id":"' || call_id || '","kind":"call","level":' || level
  || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || ',"tool":"reply","valid":' || (len(e) = 0)::VARCHAR || '}' AS json FROM j
UNION ALL
SELECT a.conv_id, call + 1, 'turn-' || call, 'orphan', NULL, NULL, false, call + 1, n, NULL, '', '{"conversation":"' || a.conv_id || '","id":"turn-' || call || '","kind":"orphan","result":' || to_json(content) || '}'
FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND a.call = u.turn WHERE u.turn IS NULL
UNION ALL
SELECT conv_id, turn, 'turn-' || turn, 'system', NULL, NULL, false, NULL, 0, NULL, '', '{"conversation":"' || conv_id || '","kind":"system","text":' || to_json(text) || '}'
FROM m WHERE role = 'system'
"""
