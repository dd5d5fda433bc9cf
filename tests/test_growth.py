"""What must not grow with the square of a group, or be written wider than its input."""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_precedence_carries_no_list_on_every_clause(spark):
    from attestra.operators import resolve

    rows = [("T1", f"R{k:03d}", "same", "STC", k % 3) for k in range(200)] + [("T1", "R900", None, "GTC", 0), ("T2", "R901", "same", "ATC", 0)]
    out = resolve.precedence(spark.createDataFrame(rows, "tender_id string, requirement_id string, field string, source_type string, source_priority int"))
    assert "Generate" not in plan(out)  # a row for each member out of its group's list
    got = {r["requirement_id"]: r for r in out.collect()}
    order = sorted((r[1] for r in rows[:200]), key=lambda i: ({0: 2}.get(int(i[1:]) % 3, int(i[1:]) % 3), i), reverse=True)
    assert len(got) == 202
    assert got[order[0]]["is_effective"] and got[order[0]]["superseded_by"] is None and got[order[0]]["supersedes"] == ", ".join(order[1:])
    assert all(not got[i]["is_effective"] and got[i]["superseded_by"] == order[0] and got[i]["supersedes"] is None for i in order[1:])
    assert all(got[i]["is_effective"] and got[i]["supersedes"] is None for i in ("R900", "R901"))


def test_requirements_are_matched_without_shuffling_a_row_for_each(spark, small):
    from attestra.operators import verify
    from attestra.plans import compliance_queries as base
    from attestra.sources import bridge

    out = verify.matched(bridge.requirements(spark), bridge.bids(spark, small), base.summary(spark, small))
    joins = [x for x in plan(out).splitlines() if "Join" in x and "bid_id#" in x]
    assert joins and not any(" AND " in x.split("Join", 1)[1] for x in joins)  # on the bid alone, not on the bid and a requirement's field


def test_what_is_known_of_bids_is_not_broadcast(spark, small, monkeypatch):
    from attestra.operators import verify
    from attestra.plans import compliance_queries as base
    from attestra.sources import bridge

    wide, long = base.profiles(spark, small), base.summary(spark, small)
    bids, reqs = bridge.bids(spark, small), bridge.requirements(spark)
    got, want = verify.matched(reqs, bids, wide), verify.matched(reqs, bids, long)
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    monkeypatch.setattr(bridge.tables, "once", lambda s, d, name, build, by=(): build())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (verify.matched(reqs, bids, wide), verify.matched(reqs, bids, long), verify.asked(reqs, bids, wide), bridge.bids(spark, small)):
            joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "[bid_id" in x]
            assert joins and not any("Broadcast" in x for x in joins)  # their files are small, their rows are not
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_methods_of_facts_are_short_enough_to_be_compiled(spark, small):
    from attestra.sources import bridge

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = bridge.facts(spark, small)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000  # the JVM compiles no longer ones
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_values_are_read_once_however_many_facts_state_them(spark, small):
    import __spark_entry__ as entry

    for name in ("h01_amount", "h03_date", "h19_typed_values"):
        lines = plan(entry.queries()[name](spark, small)).splitlines()
        at = [k for k, x in enumerate(lines) if "regexp_replace" in x or "regexp_extract" in x]
        assert at and all("value" in lines[k] and "bid_id" not in lines[k] for k in at), name


def test_facts_are_dealt_out_by_bid_once(spark, small):
    from attestra.operators import resolve
    from attestra.sources import bridge

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve.summary(bridge.facts(spark, small))._jdf.queryExecution().executedPlan().toString()
        assert found.count("Exchange hashpartitioning(bid_id") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_first_and_last_facts_are_found_without_sorting_facts(spark, small):
    from attestra.operators import resolve
    from attestra.plans import compliance_queries as base
    from attestra.sources import bridge

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve.by_bid(bridge.pages(spark, small), bridge.FIELDS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Generate" not in found and found.count("Sort [bid_id") == 1 and found.count("Exchange hashpartitioning(bid_id") == 1
    want, got = resolve.summary(bridge.facts(spark, small)), base.summary(spark, small)
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rows_of_a_bid_are_not_grouped_again(spark, small):
    from attestra.plans import compliance_queries as base, evaluation_queries as more

    for out in (base._identities(spark, small), more._sorted(spark, small)):
        assert "Aggregate" not in plan(out) and "Join" not in plan(out)


def test_registered_numbers_are_read_without_numbering_lines(spark, small):
    import __spark_entry__ as entry

    assert "Window" not in plan(entry.queries()["g06_declared_not_checked"](spark, small))


def test_documents_meet_in_pairs_and_not_facts(spark, small, monkeypatch):
    from attestra.operators import integrity
    from attestra.plans import compliance_queries as base
    from attestra.sources import bridge

    known = base.readings(spark, small)
    want = integrity.pairs(bridge.facts(spark, small), known)
    for most in (integrity.MOST_VALUES, 0):  # readings sent out, and read where the values stand
        monkeypatch.setattr(integrity, "MOST_VALUES", most)
        got = integrity.pairs_of_pages(bridge.pages(spark, small), bridge.FIELDS, known)
        lines = plan(got).splitlines()
        met = next(k for k, x in enumerate(lines) if "Join Inner" in x and "bid_id" in x)
        assert not any("Generate" in x for x in lines[met:])  # nothing is unfolded before documents meet
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_checks_join_no_rows_without_a_key(spark):
    from attestra.operators import registry

    asked = spark.createDataFrame([(b, r, i, o, "A") for b in range(40) for r, i, o in (("MCA21", "A", None), ("OEM", None, "ACME:A"), ("UDYAM", "u", "A"), ("UDYAM", "v", None), ("MII", "m", "A:GOODS"))], "bid_id long, registry string, identifier string, other string, expected_name string")
    records = spark.createDataFrame([("MCA21", "a", "A", "ACTIVE"), ("OEM", "ACME:A", "A", "ACTIVE"), ("UDYAM", "A", "A", "ACTIVE"), ("MII", "m", "B", "ACTIVE")], "registry string, key string, holder string, status string").selectExpr("*", "map('x', 'y') as details")
    out = registry.check(asked, records)
    lines = plan(out).splitlines()
    for line in (x for x in lines if "Join LeftOuter" in x):
        assert "k2#" not in line or any("isnotnull" in x and "other#" in x and "identifier#" in x for x in lines)
    assert sum("k2#" in x for x in lines if "Join LeftOuter" in x) == 1 and any("NOT" in x.upper() and "isnotnull" in x for x in lines if "Filter" in x)
    assert sorted({(r["registry"], r["identifier"], r["status"]) for r in out.collect()}, key=str) == sorted({("MCA21", "A", "VERIFIED"), ("OEM", None, "VERIFIED"), ("UDYAM", "u", "VERIFIED"), ("UDYAM", "v", "NOT_FOUND"), ("MII", "m", "IDENTITY_MISMATCH")}, key=str)
    assert out.count() == 200


def test_registry_evidence_makes_no_other_edges(spark, small, monkeypatch):
    from attestra.plans import evaluation_queries as more

    monkeypatch.setattr(more, "edges", None)
    assert more._registry_evidence(spark, small).count() > 0


def test_edges_of_a_finding_are_made_in_one_pass(spark, small):
    from attestra.plans import compliance_queries as base, evaluation_queries as more
    from attestra.operators import audit
    from attestra.sources import bridge

    found = base.findings(spark, small)
    made = audit.edges(base.results(spark, small), bridge.facts(spark, small), found, base.queue(spark, small), base.checks(spark, small), more._decided(spark, small))
    assert "format_string" not in plan(made)
    assert sum("Relation" in x and "seq_a#" in x for x in plan(made).splitlines()) == 1  # the findings are read once
    assert more.edges(spark, small).count() == more.edges(spark, small).distinct().count()
    assert more.nodes(spark, small).count() == more.nodes(spark, small).distinct().count()


def test_finding_ids_are_as_long_as_their_numbers(spark):
    from attestra.operators import rollup

    rows = spark.createDataFrame([("f", "a", 7, "b", 1234567)], "field string, raw_field_a string, seq_a int, raw_field_b string, seq_b int")
    made = rows.select(rollup.finding_id().alias("id"))
    assert "format_string" not in plan(made) and made.first()["id"] == "f-a-000007-b-1234567"


def test_a_sound_graph_is_not_searched_for_cycles_edge_by_edge(spark, monkeypatch):
    from attestra.operators import audit

    paths, scratch = [], audit.files.scratch
    monkeypatch.setattr(audit.files, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    read = []
    monkeypatch.setattr(audit.files, "drop", lambda s, p: read.append(s.read.parquet(p).count()))
    edges = spark.createDataFrame([(1, "RESULT:r", "REQ:r", "k"), (1, "REQ:r", "BLOCK:b", "k"), (2, "RESULT:r", "BLOCK:b", "k")], "bid_id long, src string, dst string, kind string")
    assert audit.cyclic_bids(edges).count() == 0
    assert sum(read) == 0 and spark.read.parquet(paths[0]).count() == 0
    looped = edges.unionByName(spark.createDataFrame([(2, "BLOCK:b", "RESULT:r", "k")], edges.schema))
    assert [r["bid_id"] for r in audit.cyclic_bids(looped).collect()] == [2]


def test_faults_are_found_without_joining_all_edges_with_all_nodes(spark, monkeypatch):
    from attestra.operators import graph

    nodes = spark.createDataFrame([(1, "REQ:r", "TENDER_REQUIREMENT"), (1, "BLOCK:b", "PHYSICAL_TEXT_BLOCK"), (1, "X:1", "GHOST"), (1, "X:1", "SPECTRE")], "bid_id long, id string, node_type string")
    edges = spark.createDataFrame([(1, "REQ:r", "BLOCK:b", "REQUIREMENT_HAS_EVIDENCE"), (1, "REQ:gone", "BLOCK:b", "REQUIREMENT_HAS_EVIDENCE"), (1, "BLOCK:b", "X:1", "FACT_GROUNDED_BY")], "bid_id long, src string, dst string, kind string")
    for most in (graph.MOST_SENT, 0):  # wrong ids sent out, and dealt out
        monkeypatch.setattr(graph, "MOST_SENT", most)
        out = graph.faults(nodes, edges)
        assert "LeftOuter" not in plan(out) and "LeftAnti" not in plan(out)
        assert sorted((r["fault"], r["id"]) for r in out.collect()) == [
            ("DANGLING_SOURCE", "REQ:gone > REQUIREMENT_HAS_EVIDENCE > BLOCK:b"), ("INVALID_ENDS", "BLOCK:b > FACT_GROUNDED_BY > X:1"), ("INVALID_NODE_TYPE", "X:1"), ("INVALID_NODE_TYPE", "X:1"), ("TYPE_CONFLICT", "X:1")
        ]


def test_a_trace_deals_out_only_edges_it_can_go_along(spark, monkeypatch):
    from attestra.operators import graph

    edges = spark.createDataFrame([(1, "A:1", "B:1", "k"), (1, "B:1", "C:1", "k"), (1, "A:1", "C:1", "k"), (1, "Z:1", "C:1", "k")], "bid_id long, src string, dst string, kind string")
    roots = spark.createDataFrame([(1, "A:1")], "bid_id long, root string")
    for most in (graph.MOST_STARTS, 0):
        monkeypatch.setattr(graph, "MOST_STARTS", most)
        assert sorted((r["id"], r["depth"]) for r in graph.reached(edges, roots, up=False).collect()) == [("B:1", 1), ("C:1", 1)]


def test_items_of_a_snapshot_are_not_written(spark, small, monkeypatch):
    from attestra.plans import evaluation_queries as more

    names, once = [], more.tables.once
    monkeypatch.setattr(more.tables, "once", lambda s, d, name, build, by=(): names.append(name) or once(s, d, name, build, by))
    more.SNAPSHOT[1](spark, small)
    assert "snapshot-digests" in names and not any(x.endswith("-items") for x in names)


def test_texts_of_versions_are_measured_once(spark):
    from attestra.operators import text

    from pyspark.sql import functions

    rows = [(1, 1, 0, "own", None, True), (1, 1, 1, "tender document no. 17, bidder turnover " * 3, 0.9, True), (1, 1, 2, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", 1.0, True), (2, 1, 0, "a text of its own that is long enough", None, True), (2, 1, 1, None, 0.9, False)]
    out = text.best_version(spark.createDataFrame(rows, "doc_id long, page_number int, pass int, text string, sure double, success boolean"))
    assert plan(out).count("regexp_extract_all") == 3  # counts of two kinds of characters, and runs: not once for each condition that reads them
    assert {(r["doc_id"], r["pass"], r["method"]) for r in out.collect()} == {(1, 1, "OCR"), (2, 0, "NATIVE_PDF")}
    shares = spark.createDataFrame([("aab",), ("abc",), ("",), (None,)], "x string").select(text.longest_run_share(functions.col("x")).alias("s"))
    assert [r["s"] for r in shares.collect()] == [0.666667, 0.333333, 0.0, 0.0]


def test_hinted_pairs_are_compared_in_methods_that_are_compiled(spark, small):
    import __spark_entry__ as entry

    from attestra.plans import compliance_queries as base

    base.pairs(spark, small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = entry.queries()["c07_hinted_pairs"](spark, small)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_claimed_value_is_read_once_and_not_for_each_phrase(spark):
    from attestra.operators import text

    from pyspark.sql import functions

    rows = spark.createDataFrame([("3 years", "warranty", "for 36 months or 12 days"), ("2 crore", "turnover_cr", "Rs. 200 lakh, 17, 200 lakh"), ("7", "lots", "x 8 y"), (None, "a", "b")], "v string, f string, t string")
    out = rows.select(text.support(functions.col("v"), functions.col("f"), functions.col("t")).alias("s"))
    assert plan(out).count("regexp_replace") < 100  # the readings of both sides, once each
    assert [r["s"] for r in out.collect()] == ["DURATION_NORMALIZED_MATCH", "CURRENCY_MATCH", "NUMERIC_MISMATCH", "EMPTY_VALUE"]


def test_pairs_are_not_written_for_one_pass_over_them(spark, small, monkeypatch):
    import __spark_entry__ as entry

    from attestra.plans import compliance_queries as base

    base.readings(spark, small)
    base.tables._WRITTEN.pop((spark.sparkContext.applicationId, small, "pairs"), None)
    names, once = [], base.tables.once
    monkeypatch.setattr(base.tables, "once", lambda s, d, name, build, by=(): names.append(name) or once(s, d, name, build, by))
    for name in ("c06_compare_values", "d12_contradictions_by_type", "d12_exact_matches", "c16_compared_facts"):
        out = entry.queries()[name](spark, small)
        assert "pairs" not in names, name
        if name == "c16_compared_facts":
            joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "bid_id" in x]
            assert joins and not any("Broadcast" in x for x in joins)  # the fields of findings are a row a bid


def test_checks_are_made_in_methods_that_are_compiled(spark, small):
    from attestra.operators import registry
    from attestra.plans import compliance_queries as base
    from attestra.sources import bridge

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = registry.check(registry.keys(base.identities(spark, small)), bridge.registry(spark, small))._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
