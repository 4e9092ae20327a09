"""DuckDB SQL for the correctness oracle.

Each registered query has an equivalent ANSI-SQL statement run by DuckDB on
the same parquet tables.  Shared steps are named CTEs; ``with_ctes`` pulls in
the ones a statement needs (dependencies first).  The SQL is written
independently of the Spark code path: plain windows (lag / row_number /
running sum) instead of the bucketed Spark plan, explicit count-then-lowest
modes, ``quantile_cont`` for medians.
"""
from __future__ import annotations

import re

# Fixed values shared with the Spark adapter (see seqlab.sources.adapter).
_VOLUMES = "['六年級', '五年級', '四年級', '三年級', '二年級', '一年級', '總複習']"
_CONTROLLED = ", ".join(str(i) for i in range(15))

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def volume_case(col: str, strict: bool = False) -> str:
    pairs = [("六", 6), ("五", 5), ("四", 4), ("三", 3), ("二", 2), ("ㄧ", 1)]
    if not strict:
        pairs.append(("一", 1))
    whens = " ".join(f"WHEN contains({col}, '{ch}') THEN {n}" for ch, n in pairs)
    return f"CAST(CASE {whens} ELSE 0 END AS INTEGER)"


def mode_cte(name: str, src: str, keys: list[str], col: str, out: str, fill: str | None = None) -> str:
    """Lowest most-frequent non-null value per key (null or ``fill`` when none)."""
    k = ", ".join(keys)
    on = " AND ".join(f"d.{x} IS NOT DISTINCT FROM m.{x}" for x in keys)
    val = f"m.{col}" if fill is None else f"COALESCE(m.{col}, {fill})"
    return f"""{name}_c AS (
  SELECT {k}, {col}, COUNT(*) AS c FROM {src} WHERE {col} IS NOT NULL GROUP BY {k}, {col}),
{name}_r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY c DESC, {col}) AS rn FROM {name}_c),
{name} AS (
  SELECT {", ".join("d." + x for x in keys)}, {val} AS {out}
  FROM (SELECT DISTINCT {k} FROM {src}) d
  LEFT JOIN (SELECT * FROM {name}_r WHERE rn = 1) m ON {on})"""


def session_ctes(src: str, prefix: str, gap_minutes: float, flavour: str = "per_character",
                 ts: str = "created_at") -> str:
    gap_us = int(round(gap_minutes * 60 * 1_000_000))
    part = "user_id, gamecharacter_id" if flavour == "per_character" else "user_id"
    return f"""{prefix}_lag AS (
  SELECT *, LAG({ts}) OVER (PARTITION BY user_id, gamecharacter_id ORDER BY {ts}, id) AS prev_time
  FROM {src} WHERE {ts} IS NOT NULL AND user_id IS NOT NULL AND gamecharacter_id IS NOT NULL),
{prefix}_flag AS (
  SELECT *, CASE WHEN prev_time IS NULL THEN 1
                 WHEN date_diff('microsecond', prev_time, {ts}) > {gap_us} THEN 1 ELSE 0 END AS new_session,
         date_diff('microsecond', prev_time, {ts}) / 1000000.0 AS time_diff
  FROM {prefix}_lag),
{prefix} AS (
  SELECT *, CAST(SUM(new_session) OVER (PARTITION BY {part} ORDER BY {ts}, id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM {prefix}_flag)"""


BASE: dict[str, str] = {}

_BLOCK = "(24 + user_id % 3 + user_id % 2)"

BASE["answer_rank"] = f"""answer_rank AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, gamecharacter_id ORDER BY ts, event_id) - 1 AS r FROM (
    SELECT event_id, user_id, value, ts, {_K} AS k,
           CASE WHEN user_id % 3 = 0 THEN user_id * 10 + event_id % 2 ELSE user_id * 10 END AS gamecharacter_id FROM events))"""

BASE["answer_spot"] = f"""answer_spot AS (
  SELECT *, (CASE WHEN place <= first_len THEN 0 ELSE 1 END + block) % 2 AS section, user_id % 4 AS a,
         CASE WHEN place <= first_len THEN place ELSE place - first_len END AS spot,
         MIN(ts) OVER (PARTITION BY user_id, gamecharacter_id, block) AS block_start
  FROM (SELECT *, 12 + user_id % 3 AS first_len, r // {_BLOCK} AS block, r % {_BLOCK} + 1 AS place FROM answer_rank))"""

BASE["answer_log"] = """answer_log AS (
  SELECT event_id AS id, user_id, gamecharacter_id,
         CAST(2 * (CASE WHEN event_id % 53 = 0 OR (user_id % 5 = 3 AND spot >= 1 + user_id % 11) THEN k % 4
                        WHEN spot IN (1, 10) THEN 0 WHEN spot IN (2, 11, 12) THEN 2
                        ELSE (s * (a + 1) + a * (s // 2) + s // 3) % 3 END) + section AS BIGINT) AS question_id,
         CAST(CASE WHEN event_id % 61 = 0 THEN NULL ELSE section END AS BIGINT) AS section_id,
         CAST(CASE WHEN event_id % 37 = 0 THEN NULL WHEN value >= 30 THEN 1 ELSE 0 END AS INTEGER) AS is_correct,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('["', chr(CAST(65 + event_id % 4 AS INTEGER)), '"]') END AS answer,
         CAST(event_id % 2 AS INTEGER) AS is_self_selected,
         CASE WHEN event_id % 101 = 0 THEN 'no time' ELSE strftime(block_start + to_seconds(
           (place - 1 - CASE WHEN user_id % 6 = 1 AND place = 3 THEN 1 ELSE 0 END) * 90
           + CASE WHEN user_id % 6 = 1 THEN 0 ELSE event_id % 60 END), '%Y-%m-%d %H:%M:%S.%f') END AS created_at_utc8
  FROM (SELECT *, CASE WHEN spot > 12 THEN spot - 10 ELSE spot END AS s FROM answer_spot))"""

BASE["exp_log"] = """exp_log AS (
  SELECT id, user_id, gamecharacter_id, question_id, section_id,
         CAST(CASE WHEN id % 4 = 0 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS INTEGER) AS experiment_index,
         is_correct, created_at_utc8
  FROM answer_log WHERE user_id % 5 <> 4)"""

BASE["question_structure"] = f"""question_structure AS (
  SELECT question_id, question_id % 2 AS section_id,
         'sec_' || CAST(question_id % 2 AS VARCHAR) AS section_name,
         CAST(CASE WHEN question_id <> 5 THEN question_id % 3 + 1 END AS INTEGER) AS difficulty_level,
         CASE WHEN question_id < 6 THEN 'math' ELSE 'lang' END AS subject_name,
         {_VOLUMES}[CAST(question_id % 7 + 1 AS INTEGER)] AS book_volume_name
  FROM (SELECT DISTINCT question_id FROM answer_log))"""

BASE["user_info"] = """user_info AS (
  SELECT user_id, CAST(4 + (user_id // 4) % 2 AS INTEGER) AS user_grade,
         'city_' || CAST(user_id % 15 AS VARCHAR) AS school_city
  FROM (SELECT DISTINCT user_id FROM events))"""

BASE["gc_course"] = """gc_course AS (
  SELECT gamecharacter_id, (user_id + gamecharacter_id) % 20 AS course_id
  FROM (SELECT DISTINCT user_id, gamecharacter_id FROM answer_log))"""

BASE["exp_dedup"] = """exp_dedup AS (
  SELECT user_id, gamecharacter_id, section_id, experiment_index FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, gamecharacter_id, section_id
                                 ORDER BY created_at_utc8 NULLS LAST, id) AS rn
    FROM exp_log) WHERE rn = 1)"""

BASE["enriched"] = """enriched AS (
  SELECT a.id, a.user_id, a.gamecharacter_id, a.question_id, a.section_id, a.is_correct, a.answer,
         a.is_self_selected, a.created_at_utc8, u.user_grade, u.school_city, e.experiment_index,
         q.section_name, q.difficulty_level, q.subject_name, q.book_volume_name, c.course_id
  FROM answer_log a
  LEFT JOIN user_info u ON a.user_id = u.user_id
  LEFT JOIN exp_dedup e ON a.user_id = e.user_id AND a.gamecharacter_id = e.gamecharacter_id
                        AND a.section_id = e.section_id
  LEFT JOIN question_structure q ON a.question_id = q.question_id
  LEFT JOIN gc_course c ON a.gamecharacter_id = c.gamecharacter_id)"""

BASE["cohort"] = f"""cohort AS (
  SELECT *, TRY_CAST(created_at_utc8 AS TIMESTAMP) AS created_at,
         {volume_case('book_volume_name')} AS manual_book_vol
  FROM enriched
  WHERE user_grade = 5 AND subject_name = 'math' AND course_id IN ({_CONTROLLED}))"""

BASE["in_sessions"] = session_ctes("cohort", "in_sessions", 30)

BASE["sess_arm"] = mode_cte("sess_arm", "in_sessions", ["user_id", "gamecharacter_id", "session_id"],
                            "experiment_index", "experiment_mode", fill="-1")

BASE["long"] = """long AS (
  SELECT i.*, CAST(ROW_NUMBER() OVER (PARTITION BY i.user_id, i.gamecharacter_id, i.session_id, i.section_id
                                 ORDER BY i.created_at, i.id) AS INTEGER) AS pos,
         COUNT(*) OVER (PARTITION BY i.user_id, i.gamecharacter_id, i.session_id, i.section_id) AS q_len,
         CAST(a.experiment_mode AS INTEGER) AS experiment_mode
  FROM in_sessions i JOIN sess_arm a
    ON i.user_id = a.user_id AND i.gamecharacter_id = a.gamecharacter_id AND i.session_id = a.session_id)"""

# Dependencies are found by name: a CTE depends on every other CTE it mentions.
_ORDER = list(BASE)


def register(name: str, body: str) -> None:
    """Add a named CTE (``name AS (...)`` text, possibly several CTEs)."""
    BASE[name] = body
    if name not in _ORDER:
        _ORDER.append(name)


def _deps(text: str) -> set[str]:
    return {n for n in BASE if re.search(rf"\b{re.escape(n)}\b", text)}


def with_ctes(select: str) -> str:
    """Prefix ``select`` with every CTE it (transitively) uses, in definition order."""
    need: set[str] = set()
    todo = list(_deps(select))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        body = BASE[n]
        own = body.split(" AS (", 1)[1]
        todo.extend(d for d in _deps(own) if d != n)
    parts = [BASE[n] for n in _ORDER if n in need]
    if not parts:
        return select
    return "WITH " + ",\n".join(parts) + "\n" + select
