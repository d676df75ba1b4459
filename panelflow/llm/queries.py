"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelflow.llm.bpe import encode_decode
from panelflow.llm.exact_dedup import exact_dedup
from panelflow.llm.filter_audit import failure_masks, interaction_audit
from panelflow.llm.fingerprints import fingerprint_documents
from panelflow.llm.jaccard import jaccard_components
from panelflow.llm.lm_scoring import score_texts
from panelflow.llm.packing import pack
from panelflow.llm.preferences import END, OPEN, final_turn_pairs, format_preferences
from panelflow.llm.repair import conversation_audit, damage, repair_turns
from panelflow.llm.sharding import SHARDS, SLOTS, place
from panelflow.llm.suffix_dedup import remove_repeats
from panelflow.llm.toxicity import score_toxicity
from panelflow.llm.warc import capture_history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    f"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS even,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
                  count(*) OVER (PARTITION BY conv_id) AS m, role, text FROM conversations),
pairs AS (SELECT pair_id, coalesce(max(m) FILTER (even), 0) AS ma FROM t GROUP BY pair_id),
sides AS (SELECT pair_id, 'c' AS side, k, role, text FROM t WHERE even
          UNION ALL SELECT pair_id, 'r', k, role, text FROM t WHERE even AND k < m
          UNION ALL SELECT pair_id, 'r', greatest(ma, 1), role, text FROM t JOIN pairs USING (pair_id) WHERE NOT even AND k = m),
joined AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k,
                  coalesce(c.role = r.role AND c.text = r.text, false) AS same
           FROM (SELECT * FROM sides WHERE side = 'c') c
           FULL JOIN (SELECT * FROM sides WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.k = r.k),
cut AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, count(*)) AS n FROM joined GROUP BY pair_id),
shown AS (SELECT pair_id, side, k, n, role, '{OPEN}' || role || chr(10) || text || '{END.strip()}' || chr(10) AS body, length(text) AS chars,
                 length(role) AS role_chars FROM sides JOIN cut USING (pair_id)),
placed AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, side, k > n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM shown),
spans AS (SELECT *, begin_at + {len(OPEN) + 1} + role_chars AS s FROM placed)
SELECT pair_id, any_value(n)::INTEGER AS prefix_turns,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg(s::BIGINT || ':' || (s + chars + {len(END)})::BIGINT, ',' ORDER BY k) FILTER (side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg(s::BIGINT || ':' || (s + chars + {len(END)})::BIGINT, ',' ORDER BY k) FILTER (side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_loss
FROM spans GROUP BY pair_id
"""
)
def op5_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return format_preferences(final_turn_pairs(table(spark, folder, "conversations")))


def _sql_fill(shards: tuple[str, ...]) -> str:
    """The table, one claim a step: shards in turn, the first free slot in the shard's order."""
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))
    return f"""
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner,
         (SELECT list((('0x' || substr(md5(s), 1, 8))::BIGINT % {SLOTS}) ORDER BY k) FROM (VALUES {names}) v(k, s)) AS offs,
         (SELECT list((('0x' || substr(md5(s), 9, 8))::BIGINT % {SLOTS - 1}) + 1 ORDER BY k) FROM (VALUES {names}) v(k, s)) AS step
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda o, i: CASE WHEN i - 1 = hit THEN who ELSE o END), offs, step
  FROM (SELECT *, turn % {len(shards)} AS who,
               list_filter(list_transform(range({SLOTS}), lambda j: (offs[turn % {len(shards)} + 1] + j * step[turn % {len(shards)} + 1]) % {SLOTS}),
                           lambda c: owner[c + 1] = -1)[1] AS hit FROM TABLE_NAME WHERE turn < {SLOTS}) q"""


_GROWN = (*SHARDS, "shard-new")


@query(
    f"""
WITH RECURSIVE a AS ({_sql_fill(SHARDS).replace('TABLE_NAME', 'a')}), b AS ({_sql_fill(_GROWN).replace('TABLE_NAME', 'b')}),
slots AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, {list(SHARDS)}[(SELECT owner FROM a WHERE turn = {SLOTS})[slot + 1] + 1] AS shard,
       {list(_GROWN)}[(SELECT owner FROM b WHERE turn = {SLOTS})[slot + 1] + 1] AS grown_shard
FROM slots
"""
)
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return place(table(spark, folder, "documents"))


@query(
    r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths in byte tokens: every UTF-8 byte is one."""
    return pack(table(spark, folder, "documents"), F.octet_length("text"))


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


TOKENIZER = "word_bpe_49k.json"


@query()
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


@query(
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""
)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    history = capture_history(table(spark, folder, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[k : k + 4] END, ' ') AS shingle
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
hops AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, hops.y FROM reach JOIN hops ON reach.y = hops.x)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM documents JOIN reach ON x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
)
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


@query(
    """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS w FROM h, unnest(range(0, greatest(n - 49, 0))) t(k)),
firsts AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
gone AS (SELECT doc_id, k FROM windows JOIN firsts USING (w) WHERE low < doc_id),
marked AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM gone),
grouped AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM marked),
spans AS (SELECT doc_id, g, min(k) AS a, max(k) + 50 AS b FROM grouped GROUP BY doc_id, g),
left_over AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM spans
  UNION ALL SELECT h.doc_id, coalesce(max(b), 0), any_value(n) FROM h LEFT JOIN spans ON spans.doc_id = h.doc_id GROUP BY h.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM left_over JOIN h USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM h JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
)
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query(
    r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
hits AS (SELECT *, list_position(list_transform(string_split(o, ''), lambda l: fails[ascii(l) - 64]), true) AS hit FROM m, orders),
cells AS (SELECT *, ascii(substr(o, step::INT, 1)) - 64 AS k FROM hits, range(1, 6) s(step)),
sums AS (SELECT part, o, step::INT AS step, any_value(k) AS k,
                sum(CASE WHEN hit IS NULL OR hit > step THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN hit = step THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN fails[k] AND hit < step THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda v: v)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN hit = step THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN hit = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
         FROM cells GROUP BY part, o, step)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM sums
"""
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interaction_audit(failure_masks(table(spark, folder, "documents"), table(spark, folder, "labels")))


_LEGAL = {"v0": (("u", "v2"), ("s", "v1")), "v1": (("u", "v2"),), "v2": (("a", "v3"),), "v3": (("u", "v2"),)}


def _sql_edit(cost: str, letter: str, line: str, then: str) -> str:
    return f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a, 'r': {line} || {then}.r}}"


def _sql_turn(state: str) -> str:
    """The cheapest, then ASCII-least, way from a state on, without insertions before the turn."""
    role, forced = ("assistant", "v3") if state == "v2" else ("user", "v2")
    ways = [_sql_edit("3", "D", "''", state), _sql_edit("CASE WHEN must THEN 1000000000 ELSE 2 + cut END", "R", f"'{role}:' || text || chr(10)", forced)]
    for initial, to in _LEGAL[state]:
        ways.append(_sql_edit(f"CASE WHEN NOT must AND initial = '{initial}' THEN cut ELSE 1000000000 END", "K", "role || ':' || text || chr(10)", to))
    return f"list_sort([{', '.join(ways)}])[1]"


def _sql_inserted(role: str, then: str) -> str:
    return _sql_edit("2", "I", f"'{role}:' || chr(10)", then)


@query(
    rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fated AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT),
                 lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM named, crc),
copies AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM copies),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k FROM seen),
judged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, substr(role, 1, 1) AS initial,
                  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended FROM placed),
t AS (SELECT *, blank OR again AS must, (unended AND NOT blank AND NOT again)::INT AS cut,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM judged),
n AS (SELECT conv_id, max(k) AS n FROM t GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS k, {{'c': 0, 'a': '', 'r': ''}} AS v0, {{'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS v1,
         {{'c': 2, 'a': 'I', 'r': 'assistant:' || chr(10)}} AS v2, {{'c': 0, 'a': '', 'r': ''}} AS v3 FROM n
  UNION ALL
  SELECT conv_id, k, list_sort([b0, {_sql_inserted('user', 'w2')}])[1], list_sort([b1, {_sql_inserted('user', 'w2')}])[1], w2, w3
  FROM (SELECT *, list_sort([b2, {_sql_inserted('assistant', 'b3')}])[1] AS w2, list_sort([b3, {_sql_inserted('user', 'b2')}])[1] AS w3
        FROM (SELECT t.conv_id, t.k, {_sql_turn('v0')} AS b0, {_sql_turn('v1')} AS b1, {_sql_turn('v2')} AS b2, {_sql_turn('v3')} AS b3
              FROM back JOIN t ON t.conv_id IS NOT DISTINCT FROM back.conv_id AND t.k = back.k - 1) p) q),
plans AS (SELECT conv_id, v0 FROM back WHERE k = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                  count(*) FILTER (cut = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
       sha256(CASE WHEN coalesce(v0.r, '') = '' THEN '' ELSE substr(v0.r, 1, length(v0.r) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_audit(repair_turns(damage(table(spark, folder, "conversations")), gone_col="gone"))


@query()
def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)
