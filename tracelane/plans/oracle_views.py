"""SQL views (as common table expressions) that state the experiment model for the oracle.

Independent of the library: plain joins, windows and self-evident formulas over the shared tables.
"""

from __future__ import annotations

BIN = "3600000.0"


def r6(expr: str) -> str:
    """Rounded to six places, without a negative zero."""
    return f"(round({expr}, 6) + 0.0)"


def to_bin(expr: str, step: str = BIN) -> str:
    return f"CAST(round_even(CAST({expr} AS DOUBLE) / {step}, 0) AS BIGINT)"


_SIDE = "CASE WHEN layer LIKE '%left%' THEN 'L' WHEN layer LIKE '%right%' THEN 'R' ELSE 'none' END"

# name -> (views it reads, definition)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev0": (
        (),
        """SELECT event_id AS seq, user_id AS participant, event_type AS et, value, ts,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS wk FROM events""",
    ),
    "ev": (
        ("ev0",),
        """SELECT participant, 'w' || wk AS trial, seq, wk, k, wk || '_' || participant || cond || side AS code,
        cond AS condition, side AS refpos,
        CASE WHEN et = 'view' THEN 'audio' ELSE 'mouse' END AS event_category,
        CASE WHEN et = 'view' THEN 'playbackstart' WHEN et = 'click' THEN 'click' ELSE 'move' END AS event_type,
        CASE WHEN k % 5 = 0 THEN 'background' WHEN k % 5 <= 2 THEN 'image-left' ELSE 'image-right' END AS layer,
        CASE WHEN et <> 'view' THEN CAST(CAST(round(value * 100) AS BIGINT) - 2000 AS DOUBLE) END AS x,
        CASE WHEN et <> 'view' THEN CAST(k * 7 AS DOUBLE) END AS y,
        CAST(epoch_us(ts) // 1000 - (1704067200000 + wk * 604800000) AS DOUBLE) AS elapsed,
        1704067200000 + wk * 604800000 AS trial_start
        FROM (SELECT *,
          CASE (participant + wk) % 3 WHEN 0 THEN 'Fluent' WHEN 1 THEN 'Disfluent' ELSE 'Filler' END AS cond,
          CASE (participant + wk) % 2 WHEN 0 THEN 'L' ELSE 'R' END AS side FROM ev0)""",
    ),
    "client": (
        ("ev",),
        """SELECT *, 'B' || (k % 4) AS browser, 'V' || (k % 4) AS version, 'O' || (k % 4) AS os,
        CASE WHEN k % 3 <> 0 THEN 'img' || k END AS image_left,
        CASE WHEN k % 3 <> 0 THEN 'pic' || k END AS image_right,
        CASE WHEN k % 3 <> 0 THEN 'snd' || k END AS audio FROM ev""",
    ),
    "att_ev": (
        ("ev",),
        """SELECT * REPLACE (CASE WHEN (participant + wk) % 4 = 3 THEN 'attention' ELSE condition END AS condition),
        CASE WHEN wk % 2 = 0 THEN 'atta.png' ELSE 'other.png' END AS image_right FROM ev""",
    ),
    "dur": (
        (),
        """SELECT CAST((r_regionkey + 1) * 1800000 AS DOUBLE) AS audio1_duration, 'w' || r_regionkey AS item,
        c.condition FROM region CROSS JOIN (VALUES ('Fluent'), ('Disfluent'), ('Filler')) c(condition)""",
    ),
    "onset": (
        ("ev",),
        """SELECT participant, trial,
        arg_min_null(elapsed, seq) FILTER (WHERE event_type = 'playbackstart') AS audio1_start
        FROM ev GROUP BY participant, trial""",
    ),
    "al": (
        ("ev", "onset", "dur"),
        """SELECT e.*, o.audio1_start, d.audio1_duration, o.audio1_start + d.audio1_duration AS audio1_end,
        e.elapsed - (o.audio1_start + d.audio1_duration) AS time
        FROM ev e JOIN onset o ON e.participant = o.participant AND e.trial = o.trial
        LEFT JOIN dur d ON d.condition = e.condition AND d.item = e.trial""",
    ),
    "oc": (
        ("al",),
        f"""SELECT participant, trial, fluency, refpos, rt, clicked_lr,
        CASE WHEN side = 'none' THEN 'none' WHEN side = refpos THEN 'ref' ELSE 'dis' END AS clicked
        FROM (SELECT *, {_SIDE.replace('layer', 'clicked_lr')} AS side FROM (
          SELECT participant, trial, arg_min_null(condition, seq) AS fluency, arg_min_null(refpos, seq) AS refpos,
          arg_max_null(time, seq) FILTER (WHERE event_type = 'click') AS rt,
          arg_max_null(layer, seq) FILTER (WHERE event_type = 'click') AS clicked_lr
          FROM al GROUP BY participant, trial))""",
    ),
    "tc": (("al",), "SELECT DISTINCT participant, trial, condition, refpos FROM al"),
    "xy": (
        ("al",),
        f"""SELECT participant, trial, {to_bin('time')} AS bin,
        CASE WHEN count(x) = count(*) THEN avg(x) END AS x, CASE WHEN count(y) = count(*) THEN avg(y) END AS y
        FROM al WHERE event_category = 'mouse' AND time IS NOT NULL GROUP BY ALL""",
    ),
    "grid": (
        ("al", "xy"),
        f"""SELECT g.participant, g.trial, g.bin, xy.x, xy.y FROM (
          SELECT participant, trial, unnest(range(min({to_bin('time')}), max({to_bin('time')}) + 1)) AS bin
          FROM al WHERE time IS NOT NULL GROUP BY participant, trial) g
        LEFT JOIN xy ON xy.participant = g.participant AND xy.trial = g.trial AND xy.bin = g.bin""",
    ),
    "filled": (
        ("grid",),
        """SELECT participant, trial, bin, last_value(x IGNORE NULLS) OVER w AS x,
        last_value(y IGNORE NULLS) OVER w AS y FROM grid
        WINDOW w AS (PARTITION BY participant, trial ORDER BY bin
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "filled_p": (
        ("grid",),
        """SELECT participant, trial, bin, last_value(x IGNORE NULLS) OVER w AS x,
        last_value(y IGNORE NULLS) OVER w AS y FROM grid
        WINDOW w AS (PARTITION BY participant ORDER BY trial, bin
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "binned": (
        ("filled", "tc"),
        """SELECT f.*, f.bin * 3600000 AS time, tc.condition, tc.refpos FROM filled f
        JOIN tc ON tc.participant = f.participant AND tc.trial = f.trial WHERE f.bin >= 0""",
    ),
    "binned_p": (
        ("filled_p", "tc"),
        """SELECT f.*, f.bin * 3600000 AS time, tc.condition, tc.refpos FROM filled_p f
        JOIN tc ON tc.participant = f.participant AND tc.trial = f.trial WHERE f.bin >= 0""",
    ),
}


def _movement(source: str) -> str:
    return f"""SELECT participant, trial, condition, refpos, bin, time, x, y, x_step_end, distance_travelled,
        cumulative_distance, ldist, rdist, ref_dist, dis_dist, ref_cdist, dis_cdist,
        CASE WHEN cumulative_distance = 0 THEN 0.0 ELSE ref_cdist / cumulative_distance END AS refprop,
        CASE WHEN cumulative_distance = 0 THEN 0.0 ELSE dis_cdist / cumulative_distance END AS disprop
        FROM (
          SELECT participant, trial, condition, refpos, bin, time, x, y,
          CASE WHEN nth > 1 THEN x END AS x_step_end,
          CASE WHEN bin = 0 THEN 0.0 ELSE step END AS distance_travelled,
          CASE WHEN bin = 0 THEN 0.0 WHEN nth > 1 AND bad_all = 0 THEN run_all END AS cumulative_distance,
          CASE WHEN bin = 0 THEN 0.0 ELSE l END AS ldist, CASE WHEN bin = 0 THEN 0.0 ELSE r END AS rdist,
          CASE WHEN bin = 0 THEN 0.0 WHEN refpos = 'L' THEN l ELSE r END AS ref_dist,
          CASE WHEN bin = 0 THEN 0.0 WHEN refpos = 'L' THEN r ELSE l END AS dis_dist,
          CASE WHEN bin = 0 THEN 0.0 WHEN nth > 1 AND x IS NOT NULL AND bad_known = 0
               THEN CASE WHEN refpos = 'L' THEN run_l ELSE run_r END END AS ref_cdist,
          CASE WHEN bin = 0 THEN 0.0 WHEN nth > 1 AND x IS NOT NULL AND bad_known = 0
               THEN CASE WHEN refpos = 'L' THEN run_r ELSE run_l END END AS dis_cdist
          FROM (
            SELECT *, sum(abs(step)) OVER w AS run_all, sum(l) OVER w AS run_l, sum(r) OVER w AS run_r,
            count(*) FILTER (WHERE nth > 1 AND step IS NULL) OVER w AS bad_all,
            count(*) FILTER (WHERE nth > 1 AND step IS NULL AND x IS NOT NULL) OVER w AS bad_known
            FROM (
              SELECT *, CASE WHEN step <= 0 THEN -step WHEN step > 0 THEN 0.0 END AS l,
              CASE WHEN step >= 0 THEN step WHEN step < 0 THEN 0.0 END AS r
              FROM (
                SELECT *, x - lag(x) OVER v AS step, row_number() OVER v AS nth FROM {source}
                WINDOW v AS (PARTITION BY participant, trial ORDER BY bin)))
            WINDOW w AS (PARTITION BY participant, trial ORDER BY bin
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


VIEWS["mv"] = (("binned",), _movement("binned"))
VIEWS["mv_p"] = (("binned_p",), _movement("binned_p"))
VIEWS["att"] = (
    ("att_ev",),
    f"""SELECT participant, count(*) AS att_checkn, count(*) FILTER (WHERE side = want) / CAST(count(*) AS DOUBLE) AS att_check
    FROM (SELECT *, {_SIDE} AS side FROM (
      SELECT participant, trial, arg_max_null(layer, seq) FILTER (WHERE event_type = 'click') AS layer,
      CASE WHEN arg_min_null(image_right, seq) LIKE '%atta%' THEN 'R' ELSE 'L' END AS want
      FROM att_ev WHERE condition = 'attention' GROUP BY participant, trial)) GROUP BY participant""",
)
VIEWS["sb"] = (
    ("ev",),
    f"""SELECT participant, count(*) FILTER (WHERE side = 'L') / CAST(count(*) AS DOUBLE) AS lside_clicks,
    count(*) FILTER (WHERE side = 'R') / CAST(count(*) AS DOUBLE) AS rside_clicks
    FROM (SELECT *, {_SIDE} AS side FROM (
      SELECT participant, trial, arg_max_null(layer, seq) FILTER (WHERE event_type = 'click') AS layer
      FROM ev GROUP BY participant, trial)) GROUP BY participant""",
)
VIEWS["ti"] = (
    ("client", "oc", "att"),
    """SELECT e.*, oc.rt AS clicktime, oc.clicked, att.att_check FROM (
      SELECT participant, trial, arg_min_null(trial_start, seq) AS trialstart,
      CAST(coalesce(bool_or(event_type = 'playbackstart'), false) AS INTEGER) AS audio_played,
      count(*) FILTER (WHERE event_type = 'move') AS datapoints,
      arg_min_null(condition, seq) AS trial_condition, arg_min_null(browser, seq) AS browser,
      arg_min_null(version, seq) AS version, arg_min_null(os, seq) AS os
      FROM client GROUP BY participant, trial) e
    JOIN oc ON oc.participant = e.participant AND oc.trial = e.trial
    LEFT JOIN att ON att.participant = e.participant""",
)
VIEWS["ti2"] = (
    ("ti",),
    """SELECT *, CASE WHEN datapoints <> 0 AND clicked <> 'none' AND clicktime >= 200 AND clicktime IS NOT NULL
    AND audio_played = 1 THEN 'valid' ELSE 'invalid' END AS include_trial FROM ti""",
)
VIEWS["pi"] = (
    ("ti",),
    """SELECT *, n_clickprenoun_nonempty / CAST(total_trials AS DOUBLE) * 100 AS p_clickprenoun_nonempty,
    (last_s - first_s) / 60.0 AS time_taken,
    make_timestamp(first_s * 1000000) AS first_time1, make_timestamp(last_s * 1000000) AS last_time
    FROM (SELECT participant, count(*) AS total_trials, count(*) FILTER (WHERE datapoints = 0) AS empty_trials,
      count(*) FILTER (WHERE trial_condition <> 'Filler') AS crit_trials,
      count(*) FILTER (WHERE trial_condition <> 'Filler' AND datapoints <> 0) AS crit_nonempty_trials,
      max(att_check) AS att_check,
      count(*) FILTER (WHERE clicked IS NOT NULL AND datapoints <> 0 AND (clicktime <= 0 OR audio_played = 0))
        AS n_clickprenoun_nonempty,
      avg(clicktime) AS avg_clicktime,
      CAST(floor(min(trialstart) FILTER (WHERE trialstart > 946684800) / 1000.0) AS BIGINT) AS first_s,
      CAST(floor(max(trialstart) / 1000.0) AS BIGINT) AS last_s,
      arg_min_null(browser, trial) AS browser, arg_min_null(version, trial) AS version, arg_min_null(os, trial) AS os
      FROM ti GROUP BY participant)""",
)
VIEWS["qs"] = (
    (),
    """SELECT c_custkey AS participant, 'language spoken' AS question, c_mktsegment AS answer, c_custkey * 2 AS seq
    FROM customer UNION ALL SELECT c_custkey, 'MTurk id', 'W' || (c_custkey // 3 * 7), c_custkey * 2 + 1
    FROM customer""",
)
VIEWS["lang"] = (
    (),
    """SELECT c_custkey AS participant, c_mktsegment AS bilingual, CASE c_mktsegment WHEN 'BUILDING' THEN 'Monolingual'
    WHEN 'FURNITURE' THEN 'Monolingual' WHEN 'MACHINERY' THEN 'Bilingual' ELSE c_mktsegment END AS bilingual2
    FROM customer""",
)
VIEWS["roster"] = (
    (),
    """SELECT 'W' || (o_custkey * 10 + month(o_orderdate) % 10) AS mturk_id, o_orderkey AS seq,
    'batch ' || o_orderstatus AS batch, o_orderpriority || ' ' || (o_orderkey % 16) AS comments FROM orders""",
)
VIEWS["ppt"] = (
    ("pi", "sb", "lang"),
    """SELECT pi.*, sb.lside_clicks, sb.rside_clicks, lang.bilingual, lang.bilingual2,
    'W' || (pi.participant // 3 * 7) AS mturk_id,
    CASE WHEN total_trials >= 5 AND crit_nonempty_trials >= 3 AND att_check >= 0.5 AND p_clickprenoun_nonempty <= 60
         AND lside_clicks >= 0.1 AND lside_clicks <= 0.9 AND avg_clicktime >= 200 THEN 'valid'
         WHEN NOT (total_trials >= 5 AND crit_nonempty_trials >= 3 AND att_check >= 0.5
         AND p_clickprenoun_nonempty <= 60 AND lside_clicks >= 0.1 AND lside_clicks <= 0.9
         AND avg_clicktime >= 200) THEN 'invalid' END AS include_ppt
    FROM pi LEFT JOIN sb ON sb.participant = pi.participant LEFT JOIN lang ON lang.participant = pi.participant""",
)
VIEWS["dups"] = (
    ("ppt", "roster"),
    """SELECT p.*, CASE WHEN coalesce(r.n > 1, false) THEN 'duplicate' ELSE 'n-dup' END AS duplicate,
    CASE WHEN coalesce(r.n > 1, false) AND NOT coalesce(f.n > 1 AND NOT r.early AND f.first_id = p.participant, false)
         THEN 'duplicate' ELSE 'n-dup' END AS duplicate2,
    CASE WHEN r.n IS NOT NULL THEN 'submitted' ELSE 'not submitted' END AS submitted
    FROM ppt p
    LEFT JOIN (SELECT mturk_id, count(*) AS n, bool_or(regexp_matches(comments, 'URGENT [37]')) AS early
               FROM roster GROUP BY mturk_id) r ON r.mturk_id = p.mturk_id
    LEFT JOIN (SELECT mturk_id, count(*) AS n, min(participant) FILTER (WHERE total_trials >= 1) AS first_id
               FROM ppt GROUP BY mturk_id) f ON f.mturk_id = p.mturk_id""",
)
VIEWS["merged"] = (
    ("mv", "ti2", "ppt"),
    """SELECT mv.*, CASE WHEN mv.participant % 2 = 0 THEN 'Mturk' ELSE 'LAB' END AS cohort,
    ti2.include_trial, ti2.clicked, ppt.include_ppt, ppt.bilingual2, ppt.total_trials
    FROM mv LEFT JOIN ti2 ON ti2.participant = mv.participant AND ti2.trial = mv.trial
    LEFT JOIN ppt ON ppt.participant = mv.participant""",
)


def statement(body: str, *views: str) -> str:
    """``body`` preceded by the views it names and all views those read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in VIEWS[name][0]:
            add(other)
        order.append(name)

    for v in views:
        add(v)
    if not order:
        return body
    # a view read more than once is computed once
    return "WITH " + ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v][1]})" for v in order) + "\n" + body
