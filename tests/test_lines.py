"""From text to events: folding, redaction, masking, templates, sessions, profiles."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from runlens.config import Config
from runlens.functions import classify, keys, mask, measure, parse
from runlens.operators import flow, lines, profile, templates, tracker, traces
from runlens.sources import ingest


def order_log():
    """26 orders: 20 achieve their purpose, 3 never reserve stock, 2 are declined, 1 is slow."""
    out = []
    for i in range(26):
        oid, minute = f"ORD-{500 + i}", i * 2
        at = lambda ms, sec=0: f"2026-10-05 {9 + minute // 60:02d}:{minute % 60:02d}:{sec:02d}.{ms:03d}"
        slow, hollow, declined = i == 16, i in (9, 22, 25), i in (14, 24)
        end = 6 if slow else 0
        out.append(f"{at(0)} INFO  checkout-api order.received order_id={oid} items={i % 4 + 1} customer=c_{i}")
        out.append(f"{at(20)} INFO  checkout-api cart.validated order_id={oid} subtotal={1000 + i}")
        out.append(f"{at(50, end)} INFO  search-svc catalogue.lookup order_id={oid} results={i} in {6000 if slow else 70 + i}ms")
        if declined:
            out.append(f"{at(300)} ERROR payment-svc payment.declined order_id={oid} reason=card")
            out.append(f"{at(400)} ERROR checkout-api order.failed order_id={oid} code=402")
            continue
        out.append(f"{at(120, end)} INFO  payment-svc payment.authorised order_id={oid} amount={900 + i} in {300 + i}ms")
        if not hollow:
            out.append(f"{at(420, end)} INFO  inventory-svc stock.reserved order_id={oid} sku=SKU-{i} qty=1")
        out.append(f"{at(520, end)} INFO  notify-svc email.queued order_id={oid} kind=confirmed")
        out.append(f"{at(700, end)} INFO  checkout-api order.completed order_id={oid} status=200 in {700 + i}ms")
    return "\n".join(out)


def test_order_log_end_to_end(lines_of):
    events = lines.lines_to_events(lines_of(order_log())).withColumn("sec", F.unix_seconds("ts")).cache()
    linked = traces.link_traces(templates.assign_templates(events, templates.mine_templates(events))).withColumn("service", F.lit("shop")).cache()
    assert linked.select("trace_id").distinct().count() == 26
    names = {r.template_id: r.t for r in linked.groupBy("template_id").agg(F.min("text_redacted").alias("t")).collect()}
    assert len(names) == 9
    purpose = [t for t, text in names.items() if "stock.reserved" in text]
    steps, spec = flow.mine_flow(linked)
    presence = {names[r.template_id].split()[2]: round(r.presence, 2) for r in steps.collect()}
    assert presence["order.received"] == 1.0 and presence["stock.reserved"] == 0.81 and presence["email.queued"] == 0.92
    verdicts = flow.judge_runs(linked, flow.mark_purpose(steps, purpose), spec)
    assert {r.verdict: r["count"] for r in verdicts.groupBy("verdict").count().collect()} == {
        "achieved": 20, "hollow": 3, "failed": 2, "degraded": 1}
    nothing = flow.judge_runs(linked, flow.mark_purpose(steps, []), spec)
    assert {r.verdict: r["count"] for r in nothing.groupBy("verdict").count().collect()} == {"unknown": 24, "failed": 2}


def test_fold_bounds_and_clock(lines_of):
    box = "10:00:00 INFO app.x: ┌ title\n" + "\n".join(f"10:00:01 INFO app.x: │ row {i}" for i in range(450)) + "\nplain line"
    for cfg in (Config(), replace(Config(), segment_rows=37)):
        got = lines.fold_continuations(lines.parse_lines(lines_of(box)), cfg).orderBy("event_no").collect()
        assert [r.folded_lines for r in got] == [200, 200, 48, 0]
        assert got[0].text.split("\n")[1] == "│ row 0" and got[3].clock == "10:00:01" and got[3].ts_basis == "carried"


def test_traceback_is_one_event(lines_of):
    text = '2026-09-05 10:00:18 ERROR app.pay: lookup FAILED\nTraceback (most recent call last):\n  File "/srv/app/pay.py", line 9, in go\n  File "/x/site-packages/lib.py", line 3, in f\nValueError: no\n2026-09-05 10:00:19 INFO app.pay: next'
    got = lines.fold_continuations(lines.parse_lines(lines_of(text))).withColumn("ev", classify.evidence_lines(F.col("text"))).orderBy("event_no").collect()
    assert [(r.level, r.folded_lines) for r in got] == [("ERROR", 4), ("INFO", 0)]
    assert got[0].ev[1:] == ['File "/srv/app/pay.py", line 9, in go']


@pytest.mark.parametrize("raw,clean,counts", [
    ("paid with 4111 1111 1111 1111 ok", "paid with <CARD> ok", {"CARD": 1}),
    ("score = 0.8163871169090271", "score = 0.8163871169090271", {}),
    ("mail a.b@x.org from 10.0.0.5", "mail <EMAIL> from <IP>", {"EMAIL": 1, "IP": 1}),
    ("Authorization: Bearer abcdef123456", "Authorization: Bearer <SECRET>", {"SECRET": 1}),
    ("api_key=sk-abcdefgh1234 took 4500000000ms", "api_key=<SECRET> took 4500000000ms", {"SECRET": 1}),
    ("from=916360722483 status=200 port=8080", "from=<PHONE> status=200 port=8080", {"PHONE": 1}),
    ("key sk-abcdefgh1234 in 12ms and 13 s", "key <TOKEN> in 12ms and 13 s", {"TOKEN": 1}),
])
def test_redaction(spark, raw, clean, counts):
    from runlens.functions.redact import redact

    row = redact(spark.createDataFrame([(raw,)], "text string"), "text").first()
    assert (row.text_redacted, row.redactions) == (clean, counts)


def test_masks_keep_status_classes_apart(spark):
    texts = ['10.0.0.1 "GET /api/orders/42 HTTP/1.1" 200 15', '10.0.0.1 "GET /api/orders/43 HTTP/1.1" 502 17', "took 12.5 ms at https://a.b/c?x=1 id 0123456789abcdef0", "", "say 'x y' and \"z\""]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source_id string, event_no long, t string").withColumn("mask", mask.mask_key(F.col("t")))
    masks = [r.mask for r in df.orderBy("event_no").collect()]
    assert "sc2xx" in masks[0] and "sc5xx" in masks[1] and "<PATH>" in masks[0]
    assert masks[2:] == ["took <DUR> at <URL> id <HEX>", "<EMPTY>", "say <STR> and <STR>"]
    assert templates.mine_templates(df).select("template_id").distinct().count() == 5


def test_templates_do_not_depend_on_partitions_or_segments(spark):
    import random

    rng = random.Random(5)
    words = [f"{rng.choice('ab')} {rng.choice('cd')} x{rng.randint(0, 30)} y{rng.randint(0, 30)} {rng.choice('ef')}" for _ in range(600)]
    df = spark.createDataFrame([("s", i, w) for i, w in enumerate(words)], "source_id string, event_no long, mask string")
    a = templates.mine_templates(df).drop("first_no")
    b = templates.mine_templates(df.repartition(7), leaf_rows=9).drop("first_no")
    assert a.exceptAll(b).count() == 0 and a.count() == len(set(words))


def _greedy(masks, similarity):
    """Every mask against every template of the leaf, one after the other."""
    known, out = [], []
    for tokens in (m.split(" ") for m in masks):
        scores = [templates._agreement(tokens, slots) for slots in known]
        best = max(range(len(known)), key=lambda i: (scores[i], -i), default=None)
        if best is None or not scores[best] or scores[best] < similarity:
            best = len(known)
            known.append(tokens)
        else:
            known[best] = [s if s == t else templates.WILDCARD for s, t in zip(known[best], tokens)]
        out.append((best, " ".join(known[best])))
    return out


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.5, 0.67, 1.0])
def test_listed_templates_give_what_all_give(similarity):
    import random

    rng, step = random.Random(8), templates._cluster(similarity)
    for n in (1, 2, 3, 5, 8):
        words = ["sc2xx", "sc5xx", templates.WILDCARD, "<NUM>", *"abcdefg"]
        masks = list(dict.fromkeys(" ".join(rng.choices(words, k=n)) for _ in range(300)))
        state, got = {}, []
        for part in (masks[:200], masks[200:203], masks[203:]):  # handed over, and few masks at a time
            if part:
                state, out = step(state, {"mask": part, "first_no": list(range(len(part)))})
                number = {t: i for i, (t, _) in enumerate(state["templates"])}
                got += [(number[t], p) for t, p in zip(out["template_id"], out["pattern"])]
        assert got == _greedy(masks, similarity)


def test_masks_that_share_little_are_not_compared(monkeypatch):
    import random

    rng, calls, agreement = random.Random(9), [], templates._agreement
    monkeypatch.setattr(templates, "_agreement", lambda *a: (calls.append(1), agreement(*a))[1])
    masks = [" ".join(["the", "of", *(f"w{rng.randrange(10_000)}" for _ in range(8))]) for _ in range(3_000)]
    templates._cluster(0.5)({}, {"mask": masks, "first_no": list(range(3_000))})
    assert len(calls) < 3_000 * 10  # 4.5 million pairs


def test_measures_and_keys(spark):
    cases = [
        ("INFO voice.tts: Synthesised 60 chars in 1136ms", 1136.0, "synthesised chars", None),
        ("Gateway ready after 2 s", 2000.0, "gateway ready", None),
        ("timeout=45.0s configured", None, None, None),
        ('done "durationMs": 45 trace_id=abcdefgh99', 45.0, None, "abcdefgh99"),
        ("order_id=ORD-1 customer_id=77777 took 5ms", 5.0, "operation", "ORD-1"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "m string")
    m = F.col("m")
    got = df.select(measure.extract_duration(m).alias("d"), measure.operation_name(m).alias("o"), keys.extract_key(m).alias("k")).collect()
    for row, (_, d, o, k) in zip(got, cases):
        assert row.d == d and row.k == k and (o is None or row.o.startswith(o))
    cost = spark.createDataFrame([("LLM node=Gen prompt_tokens=12 total_tokens=15",), ("usage: 9",)], "m string").select(measure.extract_cost(m).alias("c")).collect()
    assert (cost[0].c.label, cost[0].c.amount) == ("gen:total_tokens", 15.0)


def _linked(spark, rows, cfg=Config()):
    df = spark.createDataFrame([("s", i, float(t), x) for i, (t, x) in enumerate(rows)], "source_id string, event_no long, sec double, text_redacted string")
    return [(r.trace_id, r.correlation_basis) for r in traces.link_traces(df, cfg).orderBy("event_no").collect()]


def test_sessions(spark):
    voice = [(0, "CALL START call=abcd-1234-x"), (1, "TURN END"), (2, "hello"), (3, "CALL END call=abcd-1234-x"), (4, "after")]
    assert [b for _, b in _linked(spark, voice)] == ["extracted", "inferred", "inferred", "extracted", "none"]
    unkeyed = [(0, "request received"), (1, "work"), (2, "responded"), (3, "idle"), (4, "request received"), (5, "responded")]
    assert [k for k, _ in _linked(spark, unkeyed)] == ["req-000001"] * 3 + [None] + ["req-000002"] * 2
    late = [(0, "JOB START job_id=j-1111"), (400, "orphan")]
    assert _linked(spark, late)[1] == (None, "none")
    two = [(0, "run_id=aaaa1"), (1, "run_id=bbbb1"), (2, "whose?"), (3, "stream closed"), (4, "mine")]
    assert [b for _, b in _linked(spark, two)] == ["extracted", "extracted", "none", "none", "inferred"]


def test_sessions_do_not_depend_on_segments(spark):
    import random

    rng = random.Random(2)
    words = ["request received", "responded", "work", "order_id=o-{0:03d} step", "order_id=o-{0:03d} closed", "stream closed", "hangup", "CALL START call=call-{0:04d}"]
    t, rows = 0, []
    for _ in range(800):
        t += rng.choice([1, 5, 30, 200, 500]) if rng.random() < 0.3 else 1
        rows.append((t, rng.choice(words).format(rng.randint(0, 9))))
    assert _linked(spark, rows) == _linked(spark, rows, replace(Config(), fold_rows=50, segment_rows=60))


def test_clock_unrolls_over_midnight(spark):
    df = spark.createDataFrame([("s", 0, 86390.0), ("s", 1, None), ("s", 2, 5.0), ("s", 3, 2.0)], "source_id string, event_no long, sod double")
    got = lines.unroll_clock(df, "sod", cfg=replace(Config(), segment_rows=2)).orderBy("event_no").collect()
    assert [r.sec for r in got] == [86390.0, None, 86405.0, 86402.0]


def test_tracker_runs_and_profile(lines_of):
    text = "\n".join(["10:00:00 INFO [api] request received", "10:00:01 INFO [db] retry query", "10:00:02 INFO [api] response sent"] * 9 + ["10:00:03 INFO [api] request received", "10:00:04 ERROR [db] connection refused"])
    p = profile.learn_profile(lines_of(text)).first()
    assert (p.line_format, p.timestamp_style, p.components, p.method, p.confident) == ("bracketed", "time", ["api", "db"], "bracket-tag", True)
    named = tracker.name_components(lines.parse_lines(lines_of(text)), profile.learn_profile(lines_of(text))).withColumnRenamed("line_no", "event_no")
    runs = tracker.segment_runs(tracker.annotate_events(named), replace(Config(), segment_rows=4)).orderBy("run_no").collect()
    assert [r.status for r in runs] == ["success"] * 9 + ["failed"]
    assert runs[0].retries == 1 and runs[9].reason == "Target service refused the connection"


def test_skipped_successor_is_the_leader_so_far(spark):
    import random

    rng = random.Random(4)
    rows = [("s", i, rng.choice("abc"), rng.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "source_id string, event_no long, component string, b boolean").withColumn("branch", F.when(F.col("b"), F.struct(F.lit("retry").alias("kind"), F.lit("x").alias("label"))))
    got = {r.event_no: r.skipped for r in tracker.skip_nodes(df, replace(Config(), segment_rows=11)).collect()}
    counts, before, want = {}, None, {}
    for _, no, c, b in rows:
        if before and before != c:
            counts.setdefault(before, {})[c] = counts.get(before, {}).get(c, 0) + 1
        if b and before:
            options = counts.get(before, {})
            lead = max(options, key=options.get) if options else None
            want[no] = lead if lead and lead != c else before
        before = c
    assert got == want


def test_files_and_tables_of_vendors(spark, tmp_path):
    (tmp_path / "web.log").write_text("a\n\nb\nc")
    got = ingest.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.payload, r.service) for r in got] == [("a", "web"), ("b", "web"), ("c", "web")]
    reply = "banner\nid | name | duration_ms | error_type | total_estimated_cost\nx1 | sum up | 12 |  | 0.5\nx2 | ask | 7 | Timeout | \nshort | row"
    rows = ingest.parse_tabular_reply(spark.createDataFrame([(1, reply), (2, "no table")], "i int, reply string")).orderBy("row_no").collect()
    assert [r.payload for r in rows] == ["INFO sum up completed in 12ms cost=0.5 trace_id=x1", "ERROR ask failed in 7ms error=Timeout trace_id=x2"]
    with_ansi = spark.createDataFrame([("\x1b[31m{\"msg\": \" hi \", \"level\": \"warn\"}\x1b[0m",), ('{"msg": ""}',), ('{"a": 1}',), ("{bad",)], "t string")
    assert [r[0] for r in with_ansi.select(parse.unwrap_payload(F.col("t"))).collect()] == ["WARN hi", "", '{"a": 1}', "{bad"]
