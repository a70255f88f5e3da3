"""Ordered rules in batch and as streams, against plain replays."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.operators import leads, transitions, usage
from probatio.streaming import events as streams, ordered

START = dt.datetime(2024, 1, 1)


def log_rows(n=400, states=fv.PUBLICATION_STATES, seed=5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}",
             START + dt.timedelta(minutes=rng.randint(0, 6000)), i, rng.choice(
                 [*states, "NONSENSE"])) for i in range(n)]


def replayed(rows, table, initial):
    state, out = defaultdict(lambda: initial), {}
    for key, ts, step, requested in sorted(rows, key=lambda r: (r[1], r[2])):
        legal = requested in table[state[key]]
        before = state[key]
        state[key] = requested if legal else before
        out[step] = (before, state[key], legal)
    return out


LOG = "key string, ts timestamp, step_id bigint, requested string"


def test_replay_equals_one_pass(spark):
    rows = log_rows()
    got = transitions.replay(spark.createDataFrame(rows, LOG),
                             fv.PUBLICATION_TRANSITIONS, "DRAFT")
    assert {r.step_id: (r.state_before, r.state_after, r.allowed)
            for r in got.collect()} == replayed(rows, fv.PUBLICATION_TRANSITIONS, "DRAFT")


def stream(spark, frame, tmp_path, files=4):
    """The frame's rows as an ordered file stream, one file per micro-batch."""
    folder = str(tmp_path / "in")
    ordered = frame.coalesce(1).sortWithinPartitions(frame.columns[1])
    total = frame.count()
    rows = ordered.collect()
    for i in range(files):
        part = rows[i * total // files:(i + 1) * total // files]
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(
            folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(
        folder)


def run(query_df, name, tmp_path, mode="append"):
    query = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return query_df.sparkSession.table(name)


def passed(rows, place, minutes=10):
    """Rows that a watermark of so many minutes behind the last row has passed."""
    last = max(r[place] for r in rows) - dt.timedelta(minutes=minutes)
    return [r for r in rows if r[place] < last]


def test_streamed_fold_equals_one_pass(spark, tmp_path):
    rows = log_rows(120, fv.APPROVAL_STATES)
    frame = spark.createDataFrame(rows, LOG)
    out = run(ordered.fold_states(stream(spark, frame, tmp_path), fv.APPROVAL_TRANSITIONS,
                                  "PENDING"), "folded", tmp_path)
    assert {r.step_id: (r.state_before, r.state_after, r.allowed)
            for r in out.collect()} == replayed(passed(rows, 1), fv.APPROVAL_TRANSITIONS, "PENDING")


def test_streamed_fold_waits_for_late_steps_and_survives_a_restart(spark, tmp_path):
    """Steps arrive out of order within the delay; the query stops after each file."""
    rows = [("k", START + dt.timedelta(minutes=m), i, s) for i, (m, s) in enumerate(
        [(4, "APPROVED"), (1, "NEEDS_REVISION"), (2, "PENDING"), (9, "REJECTED"),
         (50, "APPROVED"), (49, "PENDING"), (120, "APPROVED")])]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:2], rows[2:4], rows[4:6], rows[6:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        query = (ordered.fold_states(source, fv.APPROVAL_TRANSITIONS, "PENDING").writeStream
                 .format("parquet").option("path", out).option(
                     "checkpointLocation", str(tmp_path / "state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination(240)
        assert query.exception() is None
    got = {r.step_id: (r.state_before, r.state_after, r.allowed)
           for r in spark.read.parquet(out).collect()}
    assert got == replayed(rows[:6], fv.APPROVAL_TRANSITIONS, "PENDING")


SUBMISSION = ("submission_id bigint, submitted_at timestamp, client_key string, "
              "honeypot string, elapsed_ms int")


def submissions(n=200, seed=9):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=rng.randint(0, 40_000)),
             rng.choice(["a", "a", "b", None]), rng.choice([None, None, None, "x"]),
             rng.choice([80, 5000, 5000, None])) for i in range(n)]


def expected_spam(rows):
    seen, out = defaultdict(deque), {}
    for i, ts, client, honeypot, elapsed in sorted(rows, key=lambda r: (r[1], r[0])):
        if honeypot or (elapsed is not None and elapsed < fv.MIN_ELAPSED_MS):
            out[i] = False
        elif client is None:
            out[i] = True
        else:
            out[i] = leads.accept_in_window(seen[client], ts.timestamp())
    return out


def test_spam_rule_counts_accepted_only(spark):
    rows = submissions()
    got = leads.spam_verdicts(spark.createDataFrame(rows, SUBMISSION))
    assert {r.submission_id: r.spam_reason is None for r in got.collect()} \
        == expected_spam(rows)


def test_hot_client_is_split_at_gaps(spark):
    """A client with most of the log, in bursts: many runs, the same verdicts."""
    rows = [(n, START + dt.timedelta(
        seconds=9000 * (n // 40) + 7 * (n % 40), microseconds=n),
        "hot" if n % 5 else f"c{n}", None, 9000) for n in range(2000)]
    frame = spark.createDataFrame(rows, SUBMISSION)
    got = leads.spam_verdicts(frame)
    assert {r.submission_id: r.spam_reason is None for r in got.collect()} == expected_spam(rows)
    keyed = frame.withColumns({"_slice": F.floor(F.unix_micros("submitted_at") / 3600000000)})
    runs = leads._traffic_runs(keyed).where("client_key = 'hot'").select("_run").distinct()
    assert runs.count() >= 40


def test_spam_window_edges():
    accepted = deque([0.0])
    assert all(leads.accept_in_window(accepted, t) for t in (1, 2, 3, 4))
    assert not leads.accept_in_window(accepted, 3600.0)  # the first still counts
    assert leads.accept_in_window(accepted, 3600.5)


def test_streamed_spam_equals_batch(spark, tmp_path):
    rows = submissions(80)
    out = run(ordered.spam_verdicts(stream(spark, spark.createDataFrame(rows, SUBMISSION),
                                           tmp_path)), "spam", tmp_path)
    expected = expected_spam(rows)
    counted = {i: expected[i] for i, _, client, honeypot, elapsed in passed(rows, 1)
               if client and not honeypot and not (elapsed and elapsed < 2500)}
    assert {r.submission_id: r.accepted for r in out.collect()} == counted


def test_streamed_funnel_and_counts(spark, tmp_path):
    rows = [(f"s{i % 3}", START + dt.timedelta(minutes=i * 7), t) for i, t in enumerate(
        ["PAGE_VIEW", "CTA_CLICK", "error", "LEAD_CREATED", "FORM_STARTED", "PAGE_VIEW"]
        * 8)]
    frame = spark.createDataFrame(rows, "session_id string, ts timestamp, "
                                        "event_type string")
    sessions = run(streams.funnel_sessions(stream(spark, frame, tmp_path / "a"),
                                           gap="30 minutes"), "sessions", tmp_path / "a")
    closed = {(r.session_id, r.furthest_step, r.abandoned) for r in sessions.collect()}
    assert closed and all(done == (step < 6) for _, step, done in closed)
    counts = run(streams.hourly_counts(stream(spark, frame, tmp_path / "b"),
                                       ["event_type"]), "hourly", tmp_path / "b")
    batch = {(r.hour, r.event_type): r.events for r in streams.funnel.hourly_counts(
        frame, ["event_type"]).collect()}
    got = {(r.hour, r.event_type): r.events for r in counts.collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_ingest_once_and_upsert(spark, tmp_path):
    rows = [(i % 5, START + dt.timedelta(minutes=i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "run_key int, ts timestamp")
    once = run(streams.ingest_once(stream(spark, frame, tmp_path), "run_key"), "once",
               tmp_path)
    assert sorted(r.run_key for r in once.collect()) == [0, 1, 2, 3, 4]


def test_replayed_batches_add_nothing(spark, tmp_path):
    """Eight days of rows; batches come again, also after part of one was written."""
    rows = [(i % 5, START + dt.timedelta(hours=7 * i)) for i in range(28)]
    target = str(tmp_path / "target")
    write = streams.upsert_once(target, "run_key")
    wanted = {(t.date(), k) for k, t in rows}
    batches = [spark.createDataFrame(part, "run_key int, ts timestamp")
               for part in (rows[:10], rows[8:20], rows[15:])]
    for number in (0, 1, 1, 0, 2, 2):
        write(batches[number], number)
        found = [(r.day, r.run_key) for r in spark.read.parquet(target).collect()]
        assert len(found) == len(set(found)) and set(found) <= wanted
    assert set(found) == wanted
    write(batches[0].limit(0), 3)
    assert spark.read.parquet(target).count() == len(wanted)


def test_sessions_split_at_gaps_like_session_windows(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"s{i % 7}", START + dt.timedelta(
        seconds=rng.choice([0, 1799, 1800, 1801, 5, 7200]) + 2400 * (i // 4)), rng.choice(
            ["PAGE_VIEW", "CTA_CLICK", "LEAD_CREATED", "error"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "session_id string, ts timestamp, event_type string")
    names = ["session_id", "started_at", "closed_at", "furthest_step", "events", "abandoned"]
    found = {tuple(r) for r in streams.funnel.gap_sessions(frame).select(names).collect()}
    wanted = set()
    for key in {r[0] for r in rows}:
        steps = sorted((t, fv.EVENT_TYPES.index(e) + 1) for k, t, e in rows
                       if k == key and e != "error")
        session = []
        for at, step in [*steps, (dt.datetime.max, 0)]:
            if session and (at - session[-1][0]).total_seconds() > 1800:
                top = max(n for _, n in session)
                wanted.add((key, session[0][0], session[-1][0] + dt.timedelta(minutes=30), top,
                            len(session), top < len(fv.EVENT_TYPES)))
                session = []
            session.append((at, step))
    assert found == wanted and len([w for w in wanted if w[0] == "hot"]) > 5
    assert found == {tuple(r) for r in streams.funnel_sessions(frame).select(names).collect()}


def test_budget_refuses_after_the_limit(spark):
    rows = [("j", "p", i) for i in range(6)] + [("k", "p", 1)]
    calls = spark.createDataFrame(rows, "job string, provider string, n int")
    got = usage.enforce_budget(calls, ["job", "provider"], ["n"], 3)
    assert got.where("allowed").count() == 4 and got.count() == 7


def test_export_retry_cap_and_terminal_states(spark):
    lead_rows = spark.createDataFrame([(i, "PENDING_EXPORT") for i in range(6)],
                                      "lead_id int, state string")
    codes = {0: [201], 1: [503, 200], 2: [409, 201], 3: [None] * 7, 4: [429], 5: []}
    attempts = [(i, START + dt.timedelta(hours=n), n, c, f"p{n}") for i, cs in codes.items()
                for n, c in enumerate(cs)]
    got = {r.lead_id: (r.state, r.export_attempts) for r in leads.fold_exports(
        lead_rows, spark.createDataFrame(
            attempts, "lead_id int, attempt_ts timestamp, attempt_id int, "
                      "http_status int, prospect_id string")).collect()}
    assert got == {0: ("EXPORTED", 1), 1: ("EXPORTED", 2), 2: ("EXPORT_FAILED", 1),
                   3: ("EXPORT_FAILED", 5), 4: ("PENDING_EXPORT", 1),
                   5: ("PENDING_EXPORT", 0)}
    refused = leads.fold_exports(lead_rows, spark.createDataFrame(
        attempts, "lead_id int, attempt_ts timestamp, attempt_id int, http_status int, "
                  "prospect_id string"), consent_required=False)
    assert {r.outcome for r in refused.collect()} == {"REFUSED"}


def test_export_leaves_terminal_leads_and_adds_to_stored_attempts(spark):
    stored = [(0, "EXPORTED", 1, None, "p9"), (1, "EXPORT_FAILED", 5, "old", None),
              (2, "PENDING_EXPORT", 4, "RETRYABLE: 503", None), (3, "NEW", None, None, None),
              (4, "PENDING_EXPORT", 7, None, None)]
    rows = spark.createDataFrame(stored, "lead_id int, state string, export_attempts int, "
                                         "export_error string, remote_prospect_id string")
    schema = "lead_id int, attempt_ts timestamp, attempt_id int, http_status int, prospect_id string"
    codes = {0: [409], 1: [201], 2: [503, 201], 3: [503] * 3, 4: [201]}
    first = leads.fold_exports(rows, spark.createDataFrame([
        (i, START + dt.timedelta(hours=n), n, c, f"p{n}") for i, cs in codes.items()
        for n, c in enumerate(cs)], schema))
    got = {r.lead_id: (r.state, r.export_attempts, r.export_error, r.remote_prospect_id,
                       r.ignored_attempts) for r in first.collect()}
    assert got == {
        0: ("EXPORTED", 1, None, "p9", 1), 1: ("EXPORT_FAILED", 5, "old", None, 1),
        2: ("EXPORT_FAILED", 5, "RETRY_EXHAUSTED after 5 attempt(s): 503", None, 1),
        3: ("PENDING_EXPORT", 3, "RETRYABLE: 503", None, 0),
        4: ("EXPORTED", 8, None, "p0", 0)}
    second = leads.fold_exports(first.drop("outcome", "ignored_attempts"), spark.createDataFrame(
        [(3, START, n, 429, None) for n in range(3)], schema)).where("lead_id = 3").first()
    assert (second.state, second.export_attempts, second.ignored_attempts) == (
        "EXPORT_FAILED", 5, 1)


def test_hot_key_within_one_second_spreads(spark):
    """A key with most of the log, all in one second, is read in many ranges of like size,
    and the ranges agree with one pass over the log."""
    rng = random.Random(3)
    names = [*fv.PUBLICATION_STATES, "NONSENSE", None]
    rows = [("hot" if i % 10 else f"k{i % 70}", START, i, rng.choice(names))
            for i in range(6000)]
    log = spark.createDataFrame(rows, LOG).repartition(8)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        sizes = sorted(r["count"] for r in transitions.walked_ranges(
            log, fv.PUBLICATION_TRANSITIONS, "DRAFT").groupBy("part").count().collect())
        got = transitions.replay(log, fv.PUBLICATION_TRANSITIONS, "DRAFT").collect()
    finally:
        spark.conf.unset(coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 15 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert {r.step_id: (r.state_before, r.state_after, r.allowed)
            for r in got} == replayed(rows, fv.PUBLICATION_TRANSITIONS, "DRAFT")
    audit = transitions.audit(spark.createDataFrame(got)).where("key = 'hot'").first()
    assert audit.attempts == 5400


def test_replay_of_an_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert transitions.publication_audit(empty).count() == 0
