"""The SQL that each registered query is compared with, for an engine with ANSI windows.

Written from the model and the rules it states, not from the Spark plans:
duplicates by ranking all submissions, streaks by gaps and islands over single
answers, picks by a global row number.
"""

_BASE = """
WITH bank AS (
  SELECT p_partkey AS num, CAST(p_partkey AS VARCHAR) AS id, p_name AS prompt,
    CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS cnt,
    (p_partkey // 3) % (CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END) AS correct,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS explanation,
    p_type AS topic, p_size > 5 AS enabled, p_size, p_partkey % 3 = 0 AS stored,
    p_name || ' #' || CAST(p_partkey % 100 AS VARCHAR) AS tagged
  FROM part),
opts AS (
  SELECT *, list_transform(range(cnt), lambda i: 'opt-' || CAST(i AS VARCHAR)) AS options FROM bank),
sized AS (SELECT count(*) AS n FROM part),
raw AS (
  SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS usr, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE event_type WHEN 'purchase' THEN 'quiz' WHEN 'error' THEN 'trivia' ELSE 'daily' END AS kind,
    CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS local_date,
    'G-' || event_type AS guild
  FROM events),
dated AS (
  SELECT *, CASE WHEN kind = 'daily' THEN local_date - (CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) END
    AS daily_date FROM raw),
ev AS (
  SELECT d.*,
    CASE WHEN kind = 'daily' THEN 'D-' || guild || '-' || CAST(daily_date AS VARCHAR)
      ELSE 'S-' || CAST(event_id AS VARCHAR) END AS session,
    CASE WHEN kind = 'trivia' AND k % 7 = 0 THEN usr || 'x' WHEN kind <> 'daily' THEN usr END AS owner,
    (CASE WHEN kind = 'daily' THEN (daily_date - DATE '2023-12-01') * 7 ELSE event_id * 7 END) % n
      AS qnum,
    CAST(floor((day(local_date) - 1) / 7) AS BIGINT) AS block,
    CASE WHEN kind = 'quiz'
      THEN 'R-' || usr || '-' || CAST(CAST(floor((day(local_date) - 1) / 7) AS BIGINT) AS VARCHAR) END AS run
  FROM dated d, sized),
sub AS (
  SELECT ev.* REPLACE (CASE WHEN k = 98 THEN 'X-' || event_id ELSE session END AS session),
    CAST(event_id AS VARCHAR) AS id, cnt, correct, explanation,
    CASE WHEN k = 99 THEN 7 WHEN k < 60 THEN correct ELSE k % cnt END AS selected,
    CASE WHEN user_id % 3 <> 0 THEN 'Name-' || usr || '-' || event_type ELSE 'user' || usr END AS name
  FROM ev JOIN bank ON bank.num = ev.qnum),
ses AS (
  SELECT DISTINCT session AS id, CAST(qnum AS VARCHAR) AS question_id, kind, guild,
    'C-' || event_type AS channel, owner, daily_date, run,
    CASE WHEN day(coalesce(daily_date, local_date)) % 5 <> 0 THEN 'M-' || session END AS message
  FROM (SELECT * REPLACE (CASE WHEN kind = 'daily' THEN NULL ELSE local_date END AS local_date) FROM ev)),
screened AS (
  SELECT *, CASE
    WHEN k = 98 THEN 'unknown_session'
    WHEN coalesce(owner, '') <> '' AND owner <> usr THEN 'not_owner'
    WHEN kind = 'daily' AND daily_date IS DISTINCT FROM local_date THEN 'expired'
    WHEN selected NOT BETWEEN 0 AND 4 THEN 'invalid_choice' ELSE 'ok' END AS screen
  FROM sub),
judged AS (
  SELECT *, CASE WHEN screen = 'ok' AND row_number() OVER (
      PARTITION BY session, usr, screen ORDER BY ts, event_id) > 1
    THEN 'duplicate' ELSE screen END AS verdict
  FROM screened),
acc AS (
  SELECT *, selected = correct AS ok, CASE WHEN selected = correct THEN 10 ELSE 0 END AS points
  FROM judged WHERE verdict = 'ok')
"""

# The fold of answers as gaps and islands; {reset} is the boundary of epochs.
_STREAKS = (
    _BASE
    + """,
eras AS (SELECT *, CASE WHEN ts >= TIMESTAMP '{reset}' THEN 1 ELSE 0 END AS epoch FROM acc),
marked AS (
  SELECT *, CASE WHEN ok AND daily_date - lag(daily_date) OVER (
      PARTITION BY usr, epoch ORDER BY ts, event_id) = 1 THEN 0 ELSE 1 END AS brk
  FROM eras WHERE daily_date IS NOT NULL),
islands AS (
  SELECT *, sum(brk) OVER (PARTITION BY usr, epoch ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS island FROM marked),
streaks AS (
  SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY usr, epoch, island
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM islands),
last_daily AS (
  SELECT usr, epoch, streak, daily_date FROM streaks
  QUALIFY row_number() OVER (PARTITION BY usr, epoch ORDER BY ts DESC, event_id DESC) = 1),
last_seen AS (
  SELECT usr, name, ts FROM acc
  QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts DESC, event_id DESC) = 1),
scores AS (SELECT usr, epoch, sum(points) AS total FROM eras GROUP BY usr, epoch),
prof AS (
  SELECT s.usr AS discord_user_id, s.name AS display_name,
    CAST(coalesce(t.total, 0) AS BIGINT) AS total_points,
    coalesce(d.streak, 0) AS daily_streak, d.daily_date AS last_date,
    CAST(d.daily_date AS VARCHAR) AS last_daily_date, epoch_us(s.ts) AS updated_at
  FROM last_seen s
  LEFT JOIN scores t ON t.usr = s.usr AND t.epoch = {epoch}
  LEFT JOIN last_daily d ON d.usr = s.usr AND d.epoch = {epoch})
"""
)

# All answers belong to epoch 1 when the boundary lies before the data.
_WHOLE = _STREAKS.format(reset="2000-01-01 00:00:00", epoch=1)
_RESET = _STREAKS.format(reset="2024-01-15 06:00:00", epoch=1)
_CUT = "TIMESTAMP '2024-01-20 06:00:00'"
_NOW = "epoch_us(TIMESTAMP '2024-02-01 00:00:00')"

_PROFILE = (
    "SELECT discord_user_id, display_name, total_points, daily_streak, last_daily_date, updated_at"
    " FROM prof"
)

_BOARD = (
    _WHOLE
    + """,
board AS (
  SELECT discord_user_id, display_name, total_points, daily_streak,
    CAST(row_number() OVER (ORDER BY total_points DESC, discord_user_id) AS BIGINT) AS position
  FROM prof QUALIFY position <= 10),
board_lines AS (
  SELECT *, '**' || position || '.** ' || display_name || ' — ' || total_points || ' points ('
    || daily_streak || '-day streak)' AS line FROM board)
"""
)

_ENABLED = (
    _BASE
    + """,
numbered AS (
  SELECT id, row_number() OVER (ORDER BY substr(md5(id), 1, 3), id) - 1 AS idx
  FROM bank WHERE enabled),
many AS (SELECT count(*) AS m FROM numbered)
"""
)


def _hash(text: str) -> str:
    """The repeatable number of a text, as the picks use it."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _part(digest: str, place: int) -> str:
    """The repeatable number at one place of a digest."""
    return f"CAST('0x' || substr({digest}, {12 * place + 1}, 12) AS BIGINT)"


_QUIZ = (
    _ENABLED
    + f""",
t AS (SELECT ev.*, m, sha256('quiz:7|' || event_id || '|0') AS h,
  sha256('quiz:7|' || event_id || '|order|0') AS o FROM ev, many WHERE m >= 5),
t0 AS (SELECT *, {_part("h", 0)} % (m - 4) AS d0 FROM t),
t1 AS (SELECT *, {_part("h", 1)} % (m - 3) AS x1, CASE WHEN x1 = d0 THEN m - 4 ELSE x1 END AS d1
  FROM t0),
t2 AS (SELECT *, {_part("h", 2)} % (m - 2) AS x2,
  CASE WHEN x2 IN (d0, d1) THEN m - 3 ELSE x2 END AS d2 FROM t1),
t3 AS (SELECT *, {_part("h", 3)} % (m - 1) AS x3,
  CASE WHEN x3 IN (d0, d1, d2) THEN m - 2 ELSE x3 END AS d3 FROM t2),
t4 AS (SELECT *, {_part("h", 4)} % m AS x4,
  CASE WHEN x4 IN (d0, d1, d2, d3) THEN m - 1 ELSE x4 END AS d4 FROM t3),
drawn AS (SELECT event_id, unnest([d0, d1, d2, d3, d4]) AS idx,
  unnest([{", ".join(_part("o", place) for place in range(5))}]) AS place FROM t4),
runs AS (SELECT event_id, list(numbered.id ORDER BY place, numbered.id) AS ids
  FROM drawn JOIN numbered USING (idx) GROUP BY event_id)
"""
)

_RUNS = (
    _BASE
    + """,
steps AS (SELECT run, count(*) AS steps, count(*) FILTER (ok) AS good, max(ts) AS last_ts
  FROM acc WHERE kind = 'quiz' GROUP BY run),
opened AS (SELECT run, usr, user_id, block, guild, min(ts) AS first_ts FROM ev
  WHERE kind = 'quiz' GROUP BY ALL),
progress AS (
  SELECT o.run AS id, usr, guild, first_ts, user_id, block, n,
    coalesce(steps, 0) AS idx, coalesce(good, 0) AS good,
    CASE WHEN steps >= 5 THEN last_ts END AS done,
    list_transform(range(5), lambda s: CAST((user_id * 13 + block * 31 + s) % n AS VARCHAR)) AS ids
  FROM opened o LEFT JOIN steps ON steps.run = o.run, sized)
"""
)

_CARDS = """
WITH cards AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source AS topic, 'doc-' || doc_id AS title,
    text AS body, lang, source, n_chars > 200 AS enabled,
    CASE WHEN doc_id % 5 = 0 THEN [] ELSE [source, lang] END AS warning_signs,
    CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [] END AS first_steps,
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang || '=' || source
      ELSE '=' || source || '|' || lang || '=~' END AS sections
  FROM documents),
notes AS (
  SELECT 'doc-' || doc_id AS title,
    CASE WHEN n_chars > 400 THEN 'Warning' ELSE 'Pro tip' END AS heading, source AS content
  FROM documents
  UNION ALL
  SELECT 'doc-' || doc_id, CASE WHEN toxic = 1 THEN 'Warning' ELSE 'Pro tip' END,
    'quality ' || quality FROM labels),
joined AS (
  SELECT title, string_agg(heading || '=' || coalesce(content, '~'), '|' ORDER BY heading, content NULLS FIRST)
    AS added FROM notes GROUP BY title),
noted AS (
  SELECT c.*, CASE WHEN n.title IS NULL THEN sections WHEN sections = '' THEN added
    ELSE sections || '|' || added END AS grown
  FROM cards c LEFT JOIN joined n ON n.title = c.title)
"""

_PATCHES = (
    _BASE
    + """,
patches AS (
  SELECT CAST(o_custkey * 2 AS VARCHAR) AS id, o_orderdate AS ts, o_orderkey AS patch_id,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '4') THEN 'p-' || o_orderkey END AS prompt,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '4') THEN 'w-' || o_orderkey END AS why,
    CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 't-' || o_orderkey END AS topic
  FROM orders)
"""
)

_DAILY = (
    _ENABLED
    + f""",
saved AS (
  SELECT CAST(o_custkey AS VARCHAR) AS guild, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderstatus
  FROM orders WHERE o_orderstatus IN ('F', 'P')
  QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1),
days AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS guild, CAST(o_orderdate AS DATE) AS day FROM orders),
planned AS (
  SELECT days.guild, days.day, o_orderkey,
    CASE WHEN o_orderstatus = 'F' THEN 'posted' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'new' END
      AS status,
    CASE WHEN o_orderkey IS NULL THEN {_hash("'daily:7|' || days.guild || '|' || days.day")} % m END AS idx
  FROM many, days LEFT JOIN saved ON saved.guild = days.guild AND saved.day = days.day),
assigned AS (
  SELECT guild AS guild_id, CAST(day AS VARCHAR) AS daily_date, status,
    CASE WHEN status = 'new' THEN sha256('daily|' || guild || '|' || day)
      ELSE 'O-' || o_orderkey END AS session_id,
    CASE WHEN status = 'new' THEN numbered.id ELSE CAST(o_orderkey % n AS VARCHAR) END AS question_id
  FROM sized, planned LEFT JOIN numbered USING (idx))
"""
)

# The fold after the snapshot at the cut, with a reset on the 25th.
_SNAPSHOT = _STREAKS.format(reset="2024-01-25 06:00:00", epoch=1)

# A question of the tagged bank with all its columns.
_WHOLE_QUESTION = """id, tagged AS prompt, array_to_string(options, '|') AS options,
    CAST(correct AS BIGINT) AS correct_option, explanation, topic, enabled,
    epoch_us(TIMESTAMP '2023-12-01 00:00:00') AS created_at,
    epoch_us(TIMESTAMP '2023-12-01 00:00:00') AS updated_at"""

_INTAKE = """WITH given AS (
      SELECT CAST(c_custkey AS VARCHAR) AS id,
        CASE WHEN c_custkey % 97 <> 0 THEN c_name END AS prompt, c_name AS a, c_mktsegment AS b,
        CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || '-c' END AS c,
        CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment || '-d' END AS d,
        CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '-e' END AS e,
        c_custkey % 7 AS correct,
        CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS explanation,
        CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS topic
      FROM customer),
    listed AS (SELECT *, list_filter([a, b, c, d, e], lambda x: x IS NOT NULL) AS options FROM given),
    judged_intake AS (SELECT id, prompt, topic, options,
      correct - 1 AS correct_option, explanation,
      CASE WHEN prompt IS NULL THEN 'prompt_required'
        WHEN correct NOT BETWEEN 1 AND 5 THEN 'correct_1_to_5'
        WHEN (c IS NULL) <> (d IS NULL) OR (e IS NOT NULL AND d IS NULL) THEN 'choice_count'
        WHEN correct > len(options) THEN 'correct_out_of_range' END AS reason
    FROM listed)
"""

ORACLES: dict[str, str] = {
    "leaderboard_top10": _BOARD
    + "SELECT discord_user_id, display_name, total_points, daily_streak, position, line FROM board_lines",
    "leaderboard_message": _BOARD
    + "SELECT string_agg(line, chr(10) ORDER BY position) AS text FROM board_lines",
    "submission_verdicts": _BASE + "SELECT id, verdict FROM judged",
    "reject_log": _BASE
    + """SELECT id, session AS session_id, usr AS discord_user_id, epoch_us(ts) AS answered_at,
    verdict AS reason FROM judged WHERE verdict <> 'ok'""",
    "rejects_by_reason": _BASE
    + "SELECT verdict AS reason, count(*) AS row_count FROM judged WHERE verdict <> 'ok' GROUP BY 1",
    "submissions_enriched": _BASE
    + """SELECT id, kind, guild AS guild_id, CAST(qnum AS VARCHAR) AS question_id,
    CAST(daily_date AS VARCHAR) AS daily_date, CAST(correct AS BIGINT) AS correct_option FROM sub
    WHERE k <> 98
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM sub WHERE k = 98""",
    "answers_scored": _BASE
    + """SELECT id, session AS session_id, usr AS discord_user_id,
    CAST(selected AS BIGINT) AS selected_option, ok AS is_correct,
    CAST(points AS BIGINT) AS points_awarded, epoch_us(ts) AS answered_at FROM acc""",
    "accepted_answers_scored": _BASE
    + f"""SELECT id, session AS session_id, usr AS discord_user_id,
    CAST(selected AS BIGINT) AS selected_option, ok AS is_correct,
    CAST(points AS BIGINT) AS points_awarded, epoch_us(ts) AS answered_at FROM acc WHERE ts >= {_CUT}""",
    "answer_results": _WHOLE
    + """SELECT a.id, a.session AS session_id, a.usr AS discord_user_id,
    CASE WHEN a.ok THEN '✅ Correct!' ELSE '❌ Not quite' END AS title,
    '**' || substr('ABCDE', CAST(a.correct + 1 AS BIGINT), 1) || ' — opt-' || a.correct || '**'
    || CASE WHEN regexp_matches(a.explanation, '\\S') THEN chr(10) || chr(10) || '**Why:** ' || a.explanation
       ELSE '' END
    || CASE WHEN a.ok THEN chr(10) || chr(10) || '+10 points' ELSE '' END
    || CASE WHEN s.streak IS NOT NULL THEN chr(10) || chr(10) || '🔥 **Daily streak:** ' || s.streak
       || CASE WHEN s.streak = 1 THEN ' day' ELSE ' days' END ELSE '' END AS description
    FROM acc a LEFT JOIN streaks s ON s.id = a.id""",
    "daily_streaks": _WHOLE
    + """SELECT id, usr AS discord_user_id, CAST(daily_date AS VARCHAR) AS daily_date,
    streak AS daily_streak FROM streaks""",
    "daily_streaks_with_reset": _RESET
    + "SELECT id, CAST(epoch AS BIGINT) AS epoch, streak AS daily_streak FROM streaks",
    "daily_streaks_incremental": _WHOLE
    + f"SELECT id, streak AS daily_streak FROM streaks WHERE ts >= {_CUT}",
    "profiles_rebuilt": _WHOLE + _PROFILE,
    "profiles_merged": _WHOLE + _PROFILE,
    "profiles_after_reset": _RESET
    + _PROFILE.replace(
        "updated_at FROM",
        "greatest(updated_at, epoch_us(TIMESTAMP '2024-01-15 06:00:00')) AS updated_at FROM",
    ),
    "profiles_on_snapshot": _SNAPSHOT
    + _PROFILE.replace(
        "updated_at FROM",
        "greatest(updated_at, epoch_us(TIMESTAMP '2024-01-25 06:00:00')) AS updated_at FROM",
    ),
    "scores_reset": _WHOLE
    + f"""SELECT discord_user_id, display_name, CAST(0 AS BIGINT) AS total_points,
    CAST(0 AS BIGINT) AS daily_streak, CAST(NULL AS VARCHAR) AS last_daily_date,
    {_NOW} AS updated_at FROM prof""",
    "missed_streak_reset": _WHOLE
    + f"""SELECT discord_user_id, display_name, total_points, last_daily_date,
    CASE WHEN last_date < DATE '2024-01-28' THEN 0 ELSE daily_streak END AS daily_streak,
    CASE WHEN last_date < DATE '2024-01-28' AND daily_streak > 0 THEN {_NOW} ELSE updated_at END
      AS updated_at FROM prof""",
    "quiz_progress": _RUNS
    + """SELECT id, usr AS discord_user_id, guild AS guild_id, array_to_string(ids, '|') AS question_ids,
    CAST(idx AS BIGINT) AS current_index, CAST(good AS BIGINT) AS correct_count,
    epoch_us(done) AS completed_at, epoch_us(first_ts - INTERVAL 1 MINUTE) AS created_at FROM progress""",
    "quiz_results": _RUNS
    + """SELECT id, usr AS discord_user_id, CAST(good AS BIGINT) AS correct_count,
    'You answered **' || good || '/5** correctly and earned **' || good * 10 || ' points**.' AS result
    FROM progress WHERE done IS NOT NULL""",
    "next_quiz_questions": _RUNS
    + """SELECT p.id AS quiz_run_id, usr AS discord_user_id, guild AS guild_id,
    CAST(idx AS BIGINT) AS current_index, o.id AS question_id, o.prompt,
    array_to_string(o.options, '|') AS options
    FROM progress p JOIN opts o ON o.id = ids[idx + 1] WHERE idx < 5""",
    "employee_stats_top25": _WHOLE
    + """SELECT discord_user_id, display_name, total_points, daily_streak, last_daily_date, updated_at,
    '**' || display_name || '** — ' || total_points || ' points, ' || daily_streak || '-day streak' AS line
    FROM prof ORDER BY total_points DESC, discord_user_id LIMIT 25""",
    "employee_stats_one": _WHOLE
    + """SELECT discord_user_id, display_name, total_points, daily_streak, last_daily_date, updated_at,
    '**' || display_name || '** — ' || total_points || ' points, ' || daily_streak || '-day streak' AS line
    FROM prof WHERE discord_user_id = '7'""",
    "training_activity_total": _BASE + "SELECT count(*) AS answer_count FROM acc",
    "training_activity_by_guild": _BASE
    + "SELECT guild AS guild_id, count(*) AS answer_count FROM acc GROUP BY guild",
    "question_listing": _BASE
    + """SELECT id, prompt || chr(10) || chr(10) || array_to_string(list_transform(options,
    lambda o, i: '**' || substr('ABCDE', i, 1) || '.** ' || o), chr(10))
    || chr(10) || chr(10) || 'Select an option below.' AS description FROM opts""",
    "cards_by_topic": _CARDS
    + "SELECT id, topic, title, body FROM cards WHERE enabled AND topic ILIKE '%RC1%'",
    "card_sections": _CARDS
    + """SELECT id, title, CASE WHEN doc_id % 3 = 1 THEN lang || '=' || source
    ELSE concat_ws('|',
      CASE WHEN len(warning_signs) > 0 THEN 'Warning signs=' || array_to_string(
        list_transform(warning_signs, lambda x: '• ' || x), chr(10)) END,
      CASE WHEN len(first_steps) > 0 THEN 'First steps=' || array_to_string(
        list_transform(first_steps, lambda x: '• ' || x), chr(10)) END) END AS sections
    FROM cards WHERE enabled""",
    "active_questions": _BASE
    + """SELECT id, prompt, array_to_string(options, '|') AS options,
    CAST(correct AS BIGINT) AS correct_option, explanation, topic FROM opts WHERE enabled""",
    "card_picked": f"""WITH numbered AS (
      SELECT CAST(doc_id AS VARCHAR) AS picked_id, 'doc-' || doc_id AS title,
        row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3),
          CAST(doc_id AS VARCHAR)) - 1 AS idx,
        count(*) OVER () AS m
      FROM documents WHERE n_chars > 200)
    SELECT CAST(event_id AS VARCHAR) AS request_id, picked_id, title FROM events JOIN numbered
    ON idx = {_hash("'card:7|' || event_id")} % m""",
    "trivia_assigned": _ENABLED
    + f"""SELECT sha256('trivia|' || event_id) AS id, numbered.id AS question_id, 'trivia' AS kind,
    guild AS guild_id, 'C-' || event_type AS channel_id, usr AS owner_discord_user_id,
    epoch_us(ts) AS created_at
    FROM (SELECT ev.*, {_hash("'trivia:7|' || event_id")} % m AS idx FROM ev, many)
    JOIN numbered USING (idx)""",
    "quiz_assigned": _QUIZ
    + """SELECT sha256('quiz|' || event_id) AS id, usr AS discord_user_id, guild AS guild_id,
    array_to_string(ids, '|') AS question_ids, CAST(0 AS BIGINT) AS current_index,
    CAST(0 AS BIGINT) AS correct_count, epoch_us(ts) AS created_at FROM runs JOIN ev USING (event_id)""",
    "quiz_sessions_opened": _QUIZ
    + """SELECT sha256('quiz-session|' || sha256('quiz|' || event_id) || '|0') AS id, ids[1] AS question_id,
    'quiz' AS kind, guild AS guild_id, 'C-' || event_type AS channel_id,
    usr AS owner_discord_user_id, sha256('quiz|' || event_id) AS quiz_run_id
    FROM runs JOIN ev USING (event_id)""",
    "daily_assigned": _DAILY + "SELECT * FROM assigned",
    "daily_sessions_created": _DAILY
    + f"""SELECT session_id AS id, question_id, 'daily' AS kind, guild_id, 'C-daily' AS channel_id,
    daily_date, {_NOW} AS created_at FROM assigned WHERE status = 'new'""",
    "expired_daily": _BASE
    + """SELECT id, guild AS guild_id, channel AS channel_id, message AS message_id,
    CAST(daily_date AS VARCHAR) AS daily_date FROM ses
    WHERE kind = 'daily' AND daily_date = DATE '2024-01-28' AND message IS NOT NULL""",
    "questions_inserted_missing": _BASE
    + f"""SELECT {_WHOLE_QUESTION} FROM opts b WHERE NOT stored
    AND NOT EXISTS (SELECT 1 FROM bank e WHERE e.stored AND e.tagged = b.tagged)""",
    "questions_seeded_if_empty": _BASE
    + f"""SELECT {_WHOLE_QUESTION}, CASE WHEN stored THEN 'full' ELSE 'empty' END AS start
    FROM opts""",
    "question_intake": _INTAKE
    + """SELECT id, prompt, topic, array_to_string(options, '|') AS options, correct_option, explanation,
      reason FROM judged_intake""",
    "question_intake_stored": _INTAKE
    + f"""SELECT sha256('question|' || prompt || '|' || array_to_string(options, '|')) AS id, prompt,
      array_to_string(options, '|') AS options, CAST(correct_option AS BIGINT) AS correct_option, explanation, topic,
      true AS enabled, {_NOW} AS created_at, {_NOW} AS updated_at
    FROM judged_intake WHERE reason IS NULL""",
    "questions_patched": _PATCHES
    + """, folded AS (SELECT id,
      arg_max(prompt, (ts, patch_id)) FILTER (prompt IS NOT NULL) AS prompt,
      arg_max(why, (ts, patch_id)) FILTER (why IS NOT NULL) AS why,
      arg_max(topic, (ts, patch_id)) FILTER (topic IS NOT NULL) AS topic
      FROM patches GROUP BY id)
    SELECT b.id, coalesce(f.prompt, b.prompt) AS prompt, coalesce(f.why, b.explanation) AS explanation,
      coalesce(f.topic, b.topic) AS topic, epoch_us(TIMESTAMP '2023-12-01 00:00:00') AS updated_at
    FROM bank b LEFT JOIN folded f ON f.id = b.id""",
    "patches_refused": _PATCHES
    + "SELECT id, patch_id FROM patches WHERE coalesce(prompt, why, topic) IS NULL",
    "questions_disabled": _BASE
    + """SELECT id, enabled AND num NOT IN (SELECT o_custkey * 2 FROM orders WHERE o_orderstatus = 'F')
    AS enabled FROM bank""",
    "sessions_marked_posted": _BASE
    + """, posts AS (SELECT session, event_id, event_type FROM ev WHERE k >= 50
      QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, 'P-' || event_id DESC) = 1)
    SELECT id, CASE WHEN event_id IS NULL THEN message ELSE 'P-' || event_id END AS message_id,
      CASE WHEN event_id IS NULL THEN channel ELSE 'P-' || event_type END AS channel_id
    FROM ses LEFT JOIN posts ON posts.session = ses.id""",
    "explanations_cleared": _BASE
    + f"""SELECT id, CASE WHEN explanation = 'Brand#2' THEN '' ELSE explanation END AS explanation,
    CASE WHEN explanation = 'Brand#2' THEN {_NOW}
      ELSE epoch_us(TIMESTAMP '2023-12-01 00:00:00') END AS updated_at FROM bank""",
    "cards_evolved": _CARDS
    + """SELECT id, topic, title, body, CAST(0 AS BIGINT) AS section_count,
    enabled FROM cards""",
    "card_notes_appended": _CARDS + "SELECT id, grown AS sections FROM noted",
    "cards_replaced_with_notes": _CARDS
    + "SELECT id, title, grown AS sections FROM noted",
    "table_replaced": _BASE + f"SELECT {_WHOLE_QUESTION} FROM opts WHERE NOT stored",
    "content_drop": _BASE
    + """SELECT prompt, array_to_string(options, '|') AS options, CAST(correct AS BIGINT) AS correct_option,
    explanation, topic FROM opts""",
    "card_drop": _CARDS
    + """SELECT topic, title, array_to_string(warning_signs, '|') AS warning_signs,
    array_to_string(first_steps, '|') AS first_steps, body, sections FROM cards""",
    "cascade_kept_sessions": _BASE
    + f"""SELECT id, kind, run AS quiz_run_id FROM ses WHERE run IS NULL OR run IN (
    SELECT run FROM ev WHERE run IS NOT NULL GROUP BY run HAVING min(ts) - INTERVAL 1 MINUTE < {_CUT})""",
    "cascade_kept_answers": _BASE
    + f"""SELECT id, session AS session_id FROM acc WHERE run IS NULL OR run IN (
    SELECT run FROM ev WHERE run IS NOT NULL GROUP BY run HAVING min(ts) - INTERVAL 1 MINUTE < {_CUT})""",
    "restricted_questions": _BASE
    + "SELECT id, prompt FROM bank WHERE NOT enabled AND id IN (SELECT question_id FROM ses)",
    "row_rule_violations": _BASE
    + """, broken AS (
      SELECT 'questions' AS table_name, id AS row_key, concat_ws('|',
        CASE WHEN num % 11 = 0 THEN 'prompt_required' END,
        CASE WHEN least(cnt, num % 6) NOT IN (2, 4, 5) THEN 'choice_count' END,
        CASE WHEN correct >= least(cnt, num % 6) THEN 'correct_option_range' END) AS violations
      FROM bank
      UNION ALL
      SELECT 'training_cards', CAST(doc_id AS VARCHAR), concat_ws('|',
        CASE WHEN doc_id % 13 = 0 THEN 'title_required' END,
        CASE WHEN doc_id % 17 = 0 THEN 'warning_signs_required' END)
      FROM documents
      UNION ALL
      SELECT run, id, violations FROM (
        SELECT DISTINCT 'quiz_runs' AS run, run AS id,
          CASE WHEN usr LIKE '%3' THEN 'guild_id_required' ELSE '' END AS violations
        FROM ev WHERE kind = 'quiz')
      UNION ALL
      SELECT 'question_sessions', id, CASE WHEN owner LIKE '%x' THEN 'kind' ELSE '' END FROM ses
      UNION ALL
      SELECT 'question_answers', CAST(event_id AS VARCHAR), concat_ws('|',
        CASE WHEN k = 50 THEN 'discord_user_id_required' END,
        CASE WHEN k % 7 - 1 NOT BETWEEN 0 AND 4 THEN 'selected_option_range' END,
        CASE WHEN k - 5 < 0 THEN 'points_not_negative' END)
      FROM ev
      UNION ALL
      SELECT 'employee_profiles', CAST(c_custkey AS VARCHAR), concat_ws('|',
        CASE WHEN floor(c_acctbal) < 0 THEN 'points_not_negative' END,
        CASE WHEN c_nationkey - 3 < 0 THEN 'streak_not_negative' END)
      FROM customer)
    SELECT * FROM broken WHERE violations <> ''""",
    "unique_violations": _BASE
    + """SELECT 'questions(id)' AS key_name, id AS key_value, CAST(2 AS BIGINT) AS row_count
    FROM bank WHERE NOT enabled
    UNION ALL
    SELECT 'question_sessions(id)', session, count(*) FROM ev GROUP BY session HAVING count(*) > 1
    UNION ALL
    SELECT 'question_sessions(guild_id, daily_date)', guild || '/' || CAST(daily_date AS VARCHAR), count(*)
    FROM ev WHERE daily_date IS NOT NULL GROUP BY guild, daily_date HAVING count(*) > 1
    UNION ALL
    SELECT 'question_answers(session_id, discord_user_id)', session || '/' || usr, count(*) FROM sub
    GROUP BY session, usr HAVING count(*) > 1
    UNION ALL
    SELECT 'employee_profiles(discord_user_id)', usr, count(*) FROM sub GROUP BY usr HAVING count(*) > 1
    UNION ALL
    SELECT 'quiz_runs(id)', run, count(*) FROM ev WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1""",
    "lookup_violations": _BASE
    + """SELECT CAST(event_id * 7 AS VARCHAR) AS key_value, 'missing' AS problem, count(*) AS row_count
    FROM events WHERE event_id * 7 NOT IN (SELECT num FROM bank) GROUP BY event_id
    UNION ALL
    SELECT prompt, 'duplicate', count(*) FROM bank GROUP BY prompt HAVING count(*) > 1""",
    "lookup_repeated_keys": _BASE
    + """SELECT event_id, CASE WHEN num % 5 <> 0 THEN topic END AS topic
    FROM ev LEFT JOIN bank ON num = qnum""",
    "optional_lookup": _BASE
    + """SELECT id, 'user' || usr AS username, c_mktsegment FROM sub
    LEFT JOIN customer ON c_custkey * 2 = user_id""",
    "choice_ids_parsed": _BASE
    + f"""SELECT id, session AS session_id, CASE WHEN ts < {_CUT} THEN CAST(selected AS BIGINT) END
    AS selected_option FROM sub""",
    "answer_stream": _BASE
    + """SELECT id, verdict, CASE WHEN verdict = 'ok' THEN selected = correct END AS is_correct,
    CAST(CASE WHEN verdict = 'ok' THEN CASE WHEN selected = correct THEN 10 ELSE 0 END END AS BIGINT)
    AS points_awarded FROM judged""",
    "late_clock_answers": _BASE
    + """SELECT id, verdict,
    CAST(CASE WHEN verdict = 'ok' THEN CASE WHEN selected = correct THEN 10 ELSE 0 END END AS BIGINT)
    AS points_awarded FROM judged""",
    "redelivered_presses": _BASE
    + """, twice AS (
      SELECT id, verdict, CASE WHEN verdict = 'ok' THEN CASE WHEN selected = correct THEN 10 ELSE 0 END END AS points
      FROM judged
      UNION ALL
      SELECT id, CASE WHEN screen = 'ok' THEN 'duplicate' ELSE screen END, NULL FROM judged)
    SELECT path, id, verdict, CAST(points AS BIGINT) AS points_awarded
    FROM twice, (VALUES ('batch'), ('stream')) AS paths(path)""",
    "stream_profiles_after_reset": _RESET
    + _PROFILE.replace(
        "updated_at FROM",
        "greatest(updated_at, epoch_us(TIMESTAMP '2024-01-15 06:00:00')) AS updated_at FROM",
    ),
    "stream_after_crash": _WHOLE
    + _PROFILE.replace(
        "daily_streak,",
        "CASE WHEN last_date < DATE '2024-01-15' THEN 0 ELSE daily_streak END AS daily_streak,",
    ),
    "stream_profiles_any_order": _RESET.replace(
        "PARTITION BY session, usr, screen ORDER BY ts, event_id",
        "PARTITION BY session, usr, screen ORDER BY event_id % 3, ts, event_id",
    )
    + _PROFILE.replace(
        "updated_at FROM",
        "greatest(updated_at, epoch_us(TIMESTAMP '2024-01-15 06:00:00')) AS updated_at FROM",
    ),
    "stream_quiz_progress": _RUNS
    + """SELECT id, usr AS discord_user_id, guild AS guild_id, array_to_string(ids, '|') AS question_ids,
    CAST(idx AS BIGINT) AS current_index, CAST(good AS BIGINT) AS correct_count,
    epoch_us(done) AS completed_at, epoch_us(first_ts - INTERVAL 1 MINUTE) AS created_at FROM progress""",
    "stream_next_questions": _RUNS
    + """SELECT p.id AS quiz_run_id, usr AS discord_user_id, guild AS guild_id,
    CAST(idx AS BIGINT) AS current_index, o.id AS question_id, o.prompt,
    array_to_string(o.options, '|') AS options
    FROM progress p JOIN opts o ON o.id = ids[idx + 1] WHERE idx < 5""",
    "employee_stats_message": _WHOLE
    + """, top AS (SELECT *, '**' || display_name || '** — ' || total_points || ' points, ' || daily_streak
      || '-day streak' AS line FROM prof ORDER BY total_points DESC, discord_user_id LIMIT 25)
    SELECT string_agg(line, chr(10) ORDER BY total_points DESC, discord_user_id) AS text FROM top""",
    "report_refusals": """SELECT * FROM (VALUES
      ('cards', 'No active training cards match that topic.'),
      ('trivia', 'There are no active questions yet.'),
      ('quiz', 'A quiz needs at least 5 active questions. There are currently 0.')) AS t(kind, text)
    WHERE (SELECT count(*) FROM part WHERE p_size > 5) > 0
      AND NOT EXISTS (SELECT 1 FROM documents WHERE source ILIKE '%no such topic%')""",
    "content_drop_rejects": _BASE
    + """, sorted AS (SELECT correct, CASE num % 10 WHEN 0 THEN 'not_json' WHEN 1 THEN 'options_not_a_list'
      WHEN 2 THEN 'field_type' ELSE 'stored' END AS reason FROM bank)
    SELECT reason, reason = 'stored' AS enabled, count(*) AS row_count,
      CAST(sum(CASE WHEN reason = 'stored' THEN correct END) AS BIGINT) AS key_sum
    FROM sorted GROUP BY reason""",
    "questions_replaced_whole": _WHOLE
    + """SELECT 'questions' AS table_name, count(*) AS row_count, max(id) AS last_key FROM bank WHERE NOT stored
    UNION ALL SELECT unnest(['question_sessions', 'question_answers', 'quiz_runs']), 0, NULL
    UNION ALL SELECT 'employee_profiles', count(*), max(discord_user_id) FROM prof""",
    "runs_deleted_with_children": _RUNS
    + """, late AS (
      SELECT id FROM progress WHERE first_ts - INTERVAL 1 MINUTE >= TIMESTAMP '2024-01-20 06:00:00'),
    left_ses AS (SELECT id FROM ses WHERE run IS NULL OR run NOT IN (SELECT id FROM late)),
    left_acc AS (SELECT id FROM acc WHERE session IN (SELECT id FROM left_ses))
    SELECT 'questions' AS table_name, count(*) AS row_count, max(id) AS last_key FROM bank
    UNION ALL SELECT 'question_sessions', count(*), max(id) FROM left_ses
    UNION ALL SELECT 'question_answers', count(*), max(id) FROM left_acc
    UNION ALL SELECT 'quiz_runs', count(*), max(id) FROM progress WHERE id NOT IN (SELECT id FROM late)""",
    "versions_pinned": _BASE
    + """SELECT CAST(2 AS BIGINT) AS version, id, tagged AS prompt FROM bank WHERE NOT stored
    UNION ALL SELECT 3, id, prompt FROM bank""",
    "drop_loaded_twice": _BASE
    + """SELECT CASE WHEN num % 10 = 0 THEN 'not_json' ELSE 'stored' END AS reason, prompt,
    CAST(0 AS BIGINT) AS repeated_files FROM bank""",
    "typed_scan": _WHOLE
    + """SELECT 'questions' AS table_name, count(*) AS row_count, count(DISTINCT id) AS key_count,
      CAST(9 AS BIGINT) AS column_count FROM bank
    UNION ALL SELECT 'training_cards', count(*), count(DISTINCT doc_id), 9 FROM documents
    UNION ALL SELECT 'question_sessions', count(*), count(DISTINCT id), 11 FROM ses
    UNION ALL SELECT 'question_answers', count(*), count(DISTINCT id), 7 FROM acc
    UNION ALL SELECT 'employee_profiles', count(*), count(DISTINCT discord_user_id), 6 FROM prof
    UNION ALL SELECT 'quiz_runs', count(DISTINCT run), count(DISTINCT run), 8 FROM ev""",
    "answer_stream_profiles": _WHOLE + _PROFILE,
    "stream_day_close": _WHOLE
    + """SELECT discord_user_id AS key, CAST(CASE WHEN last_date < DATE '2024-01-28' THEN 0
      ELSE daily_streak END AS VARCHAR) AS value FROM prof
    UNION ALL
    SELECT id, message FROM ses
    WHERE kind = 'daily' AND daily_date = DATE '2024-01-28' AND message IS NOT NULL""",
    "answer_stream_dedup": _BASE
    + """SELECT id, session AS session_id, usr AS discord_user_id, CAST(selected AS BIGINT) AS selected_option,
    CAST(CASE WHEN selected = correct THEN 10 ELSE 0 END AS BIGINT) AS points_awarded,
    epoch_us(ts) AS answered_at
    FROM screened WHERE kind = 'daily' AND screen = 'ok'
    QUALIFY row_number() OVER (PARTITION BY session, usr ORDER BY event_id % 3, ts, event_id) = 1""",
}
