"""Golden examples and laws of the audit operators."""

import pytest
from pyspark.sql import functions as F

from inkglass.operators import carriers, cleaning, look_alikes, markdown, metrics, profiles, reports, signals, source_code
from inkglass.plans.salted import BAD_WRAPPER, PAYLOADS, WRAPPER
from inkglass.sources import text_files
from inkglass.streaming import filter as stream_filter


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, text, column):
    return docs(spark, text).select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("“hi”—said… Bob’s", "\"hi\" - said... Bob's"),
        ("co‐op re‑enter score‒line a–b x—y m―n", "co-op re-enter score-line a-b x - y m - n"),
        ("key:\n  note: left — right\n", "key:\n  note: left - right\n"),
        ("a⁠b️c", "abc"),
        ("tail \t\n   \nend  ", "tail\n\nend"),
        ("【x】 \U000f0001﷐�", "[x]"),
        ("one\r\ntwo", "one\ntwo"),
        ("", ""),
    ],
)
def test_clean(spark, text, cleaned):
    assert one(spark, text, cleaning.clean) == cleaned


def test_clean_leaves_carriers(spark):
    good = "\ufeff" + carriers.encode_selectors(carriers.build_wrapper(b"m"))
    bad = "\ufeff" + carriers.encode_selectors(carriers.build_wrapper(b"m", 2))
    link = "<link rel=\"c2pa-manifest\" title=\"“q” – r\" href=\"https://e.org/m\">"
    text = f"“a” {good} b\u200b\n“c” {bad}{link} – d  "
    assert one(spark, text, cleaning.clean) == f"\"a\" {good} b\n\"c\" {bad}{link} - d"
    strip = lambda c: cleaning.clean(c, cleaning.CleanOptions(strip_provenance=True))
    assert one(spark, f"“a” {good}b{link}", strip) == "\"a\" b" and one(spark, None, strip) is None


def test_clean_options(spark):
    keep = lambda **o: lambda c: cleaning.clean(c, cleaning.CleanOptions(**o))
    assert one(spark, "“q”", keep(keep_quotes=True)) == "“q”"
    assert one(spark, "co‑op x—y", keep(keep_dashes=True)) == "co‑op x—y"
    assert one(spark, "a⁠b️c", keep(keep_invisible=True)) == "a⁠b️c"
    assert one(spark, "a�", keep(keep_replacement=True)) == "a�"


def test_tidy_ascii_is_unchanged_and_counts_nothing(spark):
    text = "plain \"ascii\" and apostrophe's only\n"
    row = docs(spark, text).select(cleaning.clean(F.col("text")).alias("c"), signals.total(F.col("text")).alias("t")).first()
    assert (row.c, row.t) == (text, 0)


def test_clean_makes_all_removable_signals_go(spark):
    found = signals.locations(docs(spark, *PAYLOADS).withColumn("text", cleaning.clean(F.col("text"), cleaning.CleanOptions(strip_provenance=True))))
    assert {r.signal for r in found.collect()} == set()
    kept = signals.locations(docs(spark, *PAYLOADS).withColumn("text", cleaning.clean(F.col("text"))))
    wrapped = {i for i, p in enumerate(PAYLOADS) if WRAPPER in p or BAD_WRAPPER in p}
    assert {(r.doc_id, r.signal) for r in kept.collect()} == {(i, s) for i in wrapped for s in ("default_ignorable", "variation_selector", "noninitial_bom")}


def test_every_signal_is_found_and_the_control_has_none(spark):
    rows = signals.locations(docs(spark, *PAYLOADS, None)).collect()
    from inkglass.functions.characters import SIGNALS

    assert {r.signal for r in rows} == {s for _, s, _ in SIGNALS}
    assert not [r for r in rows if r.doc_id in (0, len(PAYLOADS))]


def test_locations(spark):
    rows = signals.locations(docs(spark, "ab\nc​d\n﻿")).orderBy("offset").collect()
    assert [(r.signal, r.line, r.column, r.offset) for r in rows if r.signal != "default_ignorable"] == [("noninitial_bom", 3, 1, 7)]
    assert [(r.line, r.column, r.offset) for r in rows if r.signal == "default_ignorable"] == [(2, 2, 4), (3, 1, 7)]


def test_findings_keep_the_first_hundred_places(spark):
    row = signals.findings(docs(spark, "“" * 130)).first()
    assert (row["count"], len(row.locations), row.locations[99].offset, row.details) == (130, 100, 99, '{"locations_truncated":true}')
    assert reports.first_location(F.lit(1)) is not None


def test_metrics(spark):
    row = metrics.document_metrics(docs(spark, "one two\r\nthree")).first()
    assert (row.words, row.lines, row.newline_style, row.characters) == (3, 2, "crlf", 14)
    row = metrics.described(metrics.inventory(docs(spark, "x x"))).first()
    assert (row.code_point, row["count"], row.name, row.category) == ("U+00A0", 1, "NO-BREAK SPACE", "Zs")


def test_carriers(spark):
    good = "before﻿" + carriers.encode_selectors(carriers.build_wrapper(b"manifest")) + "after"
    bad = "before﻿" + carriers.encode_selectors(carriers.build_wrapper(b"manifest", 2)) + "after"
    block = "x\n-----BEGIN C2PA MANIFEST-----\nhttps://e.org/m\n-----END C2PA MANIFEST-----\ny"
    lone = "# -----BEGIN C2PA MANIFEST-----\nno end"
    page = "<script type=\"application/c2pa\">AAAA</script><link rel='c2pa-manifest' href='x y'>"
    rows = docs(spark, good, bad, block, lone, page, None, "").select("doc_id", carriers.carriers(F.col("text")).alias("c"), carriers.strip_carriers(F.col("text")).alias("s")).collect()
    assert [[(c.kind, c.valid) for c in r.c or []] for r in rows] == [
        [("variation_selector", True)],
        [("variation_selector", False)],
        [("structured_external_reference", True)],
        [("structured_block", False)],
        [("html_inline", True), ("html_external_reference", False)],
        [],
        [],
    ]
    assert [r.s for r in rows][:4] == ["beforeafter", bad, "x\ny", lone]


def test_markdown(spark):
    row = markdown.audit(docs(spark, "a wrapped\nparagraph\n\nline with hard break  \nnext\n")).first()
    assert (row.lines, row.soft_break_candidates, row.hard_breaks) == (5, 1, 1)
    row = markdown.audit(docs(spark, "- item wraps\n  onto this line\n- next item\n")).first()
    assert row.list_continuations == 1


@pytest.mark.parametrize("text", ["a wrapped\nparagraph\n\n- item\n  goes on\n- next\n", "> quoted\n> on\n\nx  \ny\n", "```\na\nb\n```\nc\nd", "", "| a |\n| b |\n"])
def test_unwrap_is_idempotent(text):
    done = markdown.unwrap_text(text)
    assert markdown.unwrap_text(done) == done
    assert "".join(done.split()).replace(">", "") == "".join(text.split()).replace(">", "")


def test_unwrap_joins():
    assert markdown.unwrap_text("a wrapped\nparagraph\n\n```\nx\ny\n```\n") == "a wrapped paragraph\n\n```\nx\ny\n```\n"


def test_source():
    text = "x = 'k​'  # note​\n"
    assert source_code.clean_comments_text(text, "python") == "x = 'k​'  # note\n"
    assert source_code.clean_comments_text("def broken(:  # p​\n", "python") == "def broken(:  # p​\n"
    found = source_code.scan_text("const label = 'keep​'; // remove​ this\n", "javascript")["findings"]
    assert [f["context"] for f in found] == ["strings", "comments"]
    found = source_code.scan_text("p\u0430ypal = 1", "python")["findings"]
    assert [(f["signal"], f["context"], f["removable"]) for f in found] == [("confusable_mixed_script_identifier", "identifiers", False)]


def test_source_carriers(spark):
    good, bad = ("\ufeff" + carriers.encode_selectors(carriers.build_wrapper(b"m", v)) for v in (1, 2))
    text = f"x = 1  # a{good}b\u200b {bad}\ny = 2\n"
    d = docs(spark, text).withColumn("language", F.lit("python"))
    row = source_code.clean_comments(source_code.clean_comments(d, out="kept"), out="stripped", strip_provenance=True).first()
    assert row.kept == text.replace("\u200b", "") and row.stripped == text.replace("\u200b", "").replace(good, "")
    found = source_code.findings(d).collect()
    assert [(f.line, f.column) for f in found if f.signal == "c2pa_text_carrier"] == [(1, 11)]
    assert source_code.scan(d).first().counts.comments == len(good) + 1 + len(bad)


def test_source_queries(spark):
    d = docs(spark, "int x = 'k​'; // n​\n").withColumn("language", source_code.language_of(F.lit("a.c")))
    scanned = source_code.scan(d)
    assert {r.context: r.regions for r in source_code.regions(scanned).collect()} == {"identifiers": 2, "strings": 1, "comments": 1}
    assert source_code.clean_comments(d).first().cleaned == "int x = 'k​'; // n\n"


def test_profiles(spark):
    d = docs(spark, "x LOCAL-MARK y", "plain text here", "too short")
    profile = {"profile": "p", "scheme": "literal_fixture", "marker": "LOCAL-MARK", "minimum_tokens": 3}
    assert [r.status for r in profiles.detect(d, [profile]).orderBy("doc_id").collect()] == ["detected", "not_detected", "insufficient_text"]
    assert profiles.fingerprint({**profile, "api_key": "a"}) == profiles.fingerprint({**profile, "api_key": "b"})
    assert profiles.load("/nowhere")["fingerprint"] == "unavailable"


def test_paragraphs_and_calibration(spark):
    rows = profiles.paragraphs(docs(spark, "first line\ncontinues\n\nsecond paragraph\n")).orderBy("start").collect()
    assert [(r.line, r.end_line, r.text) for r in rows] == [(1, 2, "first line\ncontinues"), (4, 4, "second paragraph")]
    s = spark.createDataFrame([(1, 5, 2.0), (1, 5, 4.0), (2, 1, 2.0)], "doc_id long, token_count long, mean_nll double")
    profile = {"method": "causal_lm_likelihood", "metric": "mean_nll", "threshold": 2.5, "comparison": "lte", "minimum_tokens": 3}
    rows = profiles.authorship(s, profile).orderBy("doc_id").collect()
    assert [(r.status, r.flagged, r.probability) for r in rows] == [("potentially_ai_generated", 1, None), ("insufficient_text", 0, None)]
    rows = profiles.authorship(s, {**profile, "calibration_slope": -2.0, "calibration_intercept": 5.0}).orderBy("doc_id").collect()
    assert round(rows[0].probability, 4) == 0.7311


def test_look_alikes(spark):
    row = look_alikes.confusable_tokens(docs(spark, "pаypal\n")).first()
    assert (row.token, row.skeleton) == ("pаypal", "paypal")
    row = look_alikes.normalization(docs(spark, "plain", "é", "ﬁ")).orderBy("doc_id").collect()
    assert [(r.nfc_changes, r.nfkc_changes) for r in row] == [(True, True), (False, True)]


def test_planned_equals_actual(spark):
    d = docs(spark, "“hello”​\n")
    row = reports.planned(d, cleaning.clean(F.col("text"))).first()
    assert row.after_characters == len('"hello"\n') and row.changed


def test_report(spark):
    wrapper = "\ufeff" + carriers.encode_selectors(carriers.build_wrapper(b"m"))
    d = docs(spark, "“hello”\u200b p\u0430ypal LOCAL-MARK x\n", "plain\n", None, f"a {wrapper}").withColumn("path", F.lit("a.md"))
    options = reports.Options(metrics=True, dry_run=True, diff=True, unwrap_markdown=True, threshold=2, categories=("typography",), watermark_profiles=({"profile": "p", "scheme": "literal_fixture", "marker": "LOCAL-MARK"},))
    rows = reports.report(d, options, path_col="path").orderBy("doc_id")
    first, plain, none, carried = rows.collect()
    assert [f.signal for f in first.findings] == ["smart_quote", "default_ignorable", "mixed_scripts", "confusable_mixed_script_token", "literal_fixture_profile_detection"]
    assert {f.signal: f["count"] for f in first.findings} == {"smart_quote": 2, "default_ignorable": 1, "mixed_scripts": 2, "confusable_mixed_script_token": 1, "literal_fixture_profile_detection": 1}
    assert first.failed and first.planned.after.characters == first.metrics.characters - 1 and first.planned.replacement_spans >= 1
    assert first.planned.resolved_findings == ["default_ignorable", "smart_quote"] and first.diff.startswith("--- a.md\n+++ a.md (cleaned)\n")
    assert plain.findings == [] and plain.total == 0 and not plain.planned.changed and plain.diff == "" and plain.markdown.lines == 1
    assert none.findings is None and none.planned is None
    assert carried.error and carried.planned is None and [f.signal for f in carried.findings][-1] == "c2pa_variation_selector_valid"
    flat = reports.csv_rows(rows).orderBy("file").first()
    assert (flat.typography, flat.unicode_security, flat.known_watermark, flat.words, flat.planned_changed) == (2, 4, 1, first.metrics.words, True)
    assert "smart_quote" in reports.human(rows).orderBy("doc_id").first().report
    # the dry run's facts are those of the cleaned text
    cleaned = reports.compose(d, options, path_col="path").filter("doc_id = 0").select("doc_id", F.col("cleaned").alias("text"))
    assert metrics.document_metrics(cleaned).first().words == first.planned.after.words


def test_report_of_source_and_authors(spark):
    d = docs(spark, "x = 1  # a\u200b\n", "one two\n\nthree four\n").withColumn("path", F.lit("a.py"))
    profile = {"profile": "a", "method": "causal_lm_likelihood", "metric": "mean_nll", "threshold": 2.5, "comparison": "lte", "minimum_tokens": 1}
    scored = profiles.paragraphs(d).withColumn("token_count", F.lit(9).cast("long")).withColumn("mean_nll", F.when(F.col("line") == 3, 1.0).otherwise(4.0))
    told = profiles.authorship_findings(scored, profile)
    rows = reports.report(d, reports.Options(source=True), path_col="path", authorship=told).orderBy("doc_id").collect()
    assert rows[0].source.language == "python" and rows[0].source.counts.comments == 1 and rows[0].source.parse_valid
    assert [(f.category, f.signal, f["count"], f.locations[0].line) for f in rows[1].findings] == [("authorship_signal", "causal_lm_likelihood_mean_nll", 1, 3)]
    statuses = profiles.authorship_many(scored, [profile, {**profile, "method": "x"}, {**profile, "calibration_slope": 1.0}]).collect()
    assert {r.status for r in statuses if r.doc_id == 1} == {"potentially_ai_generated", "unsupported", "configuration_error"}


def test_options_that_exclude_each_other():
    for wrong in ({"diff": True}, {"diff": True, "dry_run": True, "form": "csv"}, {"source": True, "unwrap_markdown": True}, {"output": "x", "inputs": 2}, {"dry_run": True, "in_place": True}):
        with pytest.raises(ValueError):
            reports.Options(**wrong).check()
    assert reports.Options(metrics=True).reports and not reports.Options(metrics=True, output="x").reports


def test_harness(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[profile]\nname = "n"\nscheme = "s"\n[detector]\nadapter = "fixture_contains"\nmarker = "MK"\nmin_characters = 3\n')
    (tmp_path / "q.toml").write_text('[profile]\nname = "n"\n')
    p, q = (profiles.load_harness(str(tmp_path / n)) for n in ("p.toml", "q.toml"))
    run = lambda profile: [r.s.status for r in docs(spark, "MK MK", "none", "MK").select(profiles.harness_status(F.col("text"), profile).alias("s"), "doc_id").orderBy("doc_id").collect()]
    assert run(p) == ["detected", "not_detected", "insufficient_text"] and run(q) == ["configuration_error"] * 3
    assert run({**p, "detector": {"adapter": "unsupported"}}) == ["unsupported"] * 3 and run({**p, "detector": {"adapter": "x", "min_characters": -1}}) == ["configuration_error"] * 3


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    good, bad = text_files.read_texts(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), str(tmp_path / "a.txt"))
    assert [(r.text, r.eol) for r in good.collect()] == [("one\r\ntwo", "\r\n")]
    assert bad.count() == 1
    names = spark.createDataFrame([("d/a.txt",), ("d/a",)], "p string").select(text_files.clean_name(F.col("p")).alias("n")).collect()
    assert [r.n for r in names] == ["d/a.clean.txt", "d/a.clean"]


def test_files_are_written_and_replaced(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("“one”\r\ntwo\r\n".encode())
    good, _ = text_files.read_texts(spark, str(tmp_path / "a.txt"))
    done = good.withColumn("text", cleaning.clean(F.col("text")))
    (out,) = text_files.write_texts(done, str(tmp_path / "out")).collect()
    assert out.written.endswith("/out/a.clean.txt") and (tmp_path / "out" / "a.clean.txt").read_bytes() == b'"one"\r\ntwo\r\n'
    (tmp_path / "a.txt.tmp").write_bytes(b"not ours")
    (row,) = text_files.replace_in_place(done, backup=True).collect()
    assert row.backup.endswith("a.txt.tmp.1") and (tmp_path / "a.txt.tmp.1").read_bytes().startswith("“".encode())
    assert text_files.replace_in_place(done, backup=True).first().backup is None
    assert (tmp_path / "a.txt").read_bytes() == b'"one"\r\ntwo\r\n' and (tmp_path / "a.txt.tmp").read_bytes() == b"not ours"
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.txt", "a.txt.tmp", "a.txt.tmp.1", "out"]


def test_long_lines_of_loops(spark):
    text = "\n".join(["word"] * 20_000) + "\n" + "- " * 20_000 + "\n" + "|---" * 20_000 + "|"
    assert profiles.paragraphs(docs(spark, text)).count() == 1
    assert markdown.audit(docs(spark, text)).first().lines == 20_002


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("“a”\n")
    stream = stream_filter.clean_stream(spark.readStream.text(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert [r.value for r in spark.table("cleaned").collect()] == ['"a"']


def test_fingerprints_of_a_table_are_those_of_profiles(spark):
    configs = [{"profile": "a", "scheme": "kgw", "api_key": "x", "tokenizer_path": "/t", "Seed": "7"}, {"profile": 'q"\\', "marker": "m"}, {}]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(configs)], "i int, config map<string,string>")
    found = {r.i: r.fingerprint for r in profiles.fingerprints(rows).collect()}
    assert found == {i: profiles.fingerprint(c) for i, c in enumerate(configs)}
    other = {**configs[0], "api_key": "y", "Seed": "8"}
    assert profiles.fingerprint(other) == found[0]
