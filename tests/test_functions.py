import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import anchors
from lodestone.functions import text as txt
from lodestone.operators import deadlines, ledger, retrieve, verify
from lodestone.sources import files, rules


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_stems_of_inflections_agree(spark):
    words = "doręczono doręczenie doręczenia samochód samochodu świadek świadka świadkiem 147/26 2026".split()
    found = [x[0] for x in values(spark, txt.tokens, *words)]
    assert found[0] == found[1] == found[2] and found[6] == found[7]
    assert found[8:] == ["147/26", "2026"] and not any("ł" in f for f in found)


def test_english_stop_words_only_in_english(spark):
    assert values(spark, lambda t: txt.tokens(t, "en"), "on the motion")[0] == ["motion"]
    assert values(spark, txt.tokens, "on the motion")[0] == ["on", "the", "motion"]


@pytest.mark.parametrize("seed", range(4))
def test_stem_regex_cuts_the_longest_ending(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioumywchnst") for _ in range(rnd.randint(2, 12))) for _ in range(300)]

    def brute(w):
        for e in sorted(set(txt.ENDINGS), key=len, reverse=True):
            if w.endswith(e) and len(w) - len(e) >= 4:
                return w[: -len(e)]
        return w

    assert values(spark, txt.stem, *words) == [brute(w) for w in words]


def test_sentences_keep_offsets_and_abbreviations(spark):
    texts = ["Pursuant to art. 5 of the act the court decided so. The second sentence is here too!", "One short. No. 5 is a number that continues the sentence here. End of this long text", "", "   ", "No end mark but long enough to stand"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", txt.sentences(F.col("t"), F.lit("en")).alias("s")).orderBy("i").collect()
    assert [len(r["s"]) for r in rows] == [2, 1, 0, 0, 1]
    for r in rows:
        for k, s in enumerate(r["s"], 1):
            assert s["sent_no"] == k and r["t"][s["start"] : s["end"]] == s["text"] == s["text"].strip()


def test_fragments_overlap_and_cover():
    text = ("A sentence of some length stands here. " * 200).strip()
    spans = txt.fragment_spans(text, 1400, 250)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] < a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False))
    assert txt.fragment_spans("", 1400, 250) == [] and txt.fragment_spans("abc", 1400, 250) == [(0, 3)]


def test_cleaning(spark):
    clean = lambda t: values(spark, txt.clean_html, t)[0]
    assert clean("<p>One</p><p>Two</p>") == "One\nTwo"
    assert clean("a < b and < 1000") == "a < b and < 1000"
    assert clean("<script>var x='</p>';</script>Body &amp; more") == "Body & more"
    assert "\n\n\n" not in clean("<div>a</div><br><br><br><div>b</div>")
    assert clean("clean text") == "clean text"
    assert values(spark, lambda t: txt.clean_html(t, True), "ksi&oacute;g <b>x</b>")[0] == "ksióg x"


def test_language(spark):
    pl = "sąd uznał że wyrok w sprawie jest zgodny z prawem i nie może być zmieniony przez sąd na wniosek strony"
    en = "the court held that the motion of the defendant was denied and that it shall be filed by the clerk of court"
    assert [r["lang"] for r in values(spark, txt.language, pl, en, "the court of", "1 2 3 4")] == ["pl", "en", "unknown", "unknown"]


def test_dates_of_every_spelling(spark):
    same = ["October 6, 2016", "6 October 2016", "October 6th, 2016", "Oct. 6, 2016", "2016-10-06", "8th day of June, 2018", "6 października 2016", "6 PAŹDZIERNIKA 2016"]
    found = values(spark, anchors.dates, *same)
    assert found[5] == ["2018-06-08"] and all(f == ["2016-10-06"] for k, f in enumerate(found) if k != 5)
    assert values(spark, anchors.dates, "10/6/2016", "25/6/2016", "13/45/2016", "32 October 2016", "2016-02-31") == [
        ["2016-06-10", "2016-10-06"], ["2016-06-25"], [], [], ["2016-02-31"],
    ]


def test_amounts_and_references(spark):
    assert values(spark, anchors.amounts, "1.008,00 zł", "1008 zł", "1 008,00 PLN", "$12,500", "1008") == [["1008.00"]] * 3 + [["12500.00"], []]
    assert values(spark, anchors.references, "II K 147/26", "II K 147/2026", "2:18-cr-00422", "art. 445 § 1", "art.445 §1", "8 lat", "51 years", "14 days", "2025 roku", "18 U.S.C. \n§ 3142(e)") == [
        ["iik147/26"], ["iik147/26"], ["2:18-cr-422"], ["art445§1"], ["art445§1"], ["okres8r"], ["okres51r"], ["okres14d"], [], ["usc18§3142(e)"],
    ]


def test_anchoring_and_support(spark):
    df = spark.createDataFrame(
        [("on October 6, 2016?", "signed 2016-10-06"), ("on October 6, 2016?", "in 2016"), ("why so?", "because"), ("page 12?", "see 12")], "q string, c string"
    )
    assert [r[0] for r in df.select(anchors.anchored(F.col("q"), F.col("c"))).collect()] == [True, False, True, True]
    claims = spark.createDataFrame(
        [("He paid 500 zł", "He paid it", ""), ("three of 7 witnesses", "three witnesses", ""), ("the court granted motion", "motion granted by the court", ""), ("", "x", "")],
        "c string, q string, k string",
    )
    found = [r[0]["degree"] for r in claims.select(verify.support(F.col("c"), F.col("q"), F.col("k"), "en")).collect()]
    assert found == ["none", "weak", "strong", "none"]


def test_citation_verdicts_and_location(spark):
    source = "The deadline is 14  days — from “service”."
    rows = [(source, 0, 12, "The deadline"), (source, 0, 100, "x"), (source, -1, 3, "x"), (source, 16, 18, "4"), (None, 0, 1, "x"), (source, 16, 42, '14 days - from "service".')]
    df = spark.createDataFrame(rows, "s string, a int, b int, q string")
    got = [r[0] for r in df.select(verify.citation_verdict(F.col("s"), F.col("a"), F.col("b"), F.col("q"))).collect()]
    assert got == ["confirmed", "out_of_range", "out_of_range", "different_text", "no_document", "confirmed"]
    spots = spark.createDataFrame([(source, '14 DAYS\n- from "service"'), (source, "15 days"), (source, " ")], "s string, f string")
    assert [r[0] and tuple(r[0]) for r in spots.select(verify.locate_tolerant(F.col("s"), F.col("f"))).collect()] == [(16, 41), None, None]


def test_votes(spark):
    picks = [(1, d, s) for d, row in enumerate([[3], [3], [3, 99]]) for s in row] + [(2, d, s) for d, row in enumerate([[5, 5, 5], [9], [9]]) for s in row]
    out = verify.count_votes(spark.createDataFrame(picks, "question_id long, draw long, sent_no long")).collect()
    assert {(r["question_id"], r["sent_no"], r["votes"]) for r in out if r["passed"]} == {(1, 3, 3), (2, 9, 2)}


def test_deadlines(spark):
    days = deadlines.calendar(spark, "2026-01-01", "2026-12-31")
    events = spark.createDataFrame([("doreczenie_wyroku_z_uzasadnieniem", "2026-08-12"), ("ogloszenie_wyroku", "2026-08-01")], "event string, d string").select("event", F.to_date("d").alias("event_date"))
    out = {(r["rule_id"]): (str(r["raw_due"]), str(r["due"]), r["status"]) for r in deadlines.deadlines(events, deadlines.default_rules(spark), days).collect()}
    assert out["apelacja_karna"] == ("2026-08-26", "2026-08-26", "unapproved_rule")
    assert out["wniosek_o_uzasadnienie_karne"] == ("2026-08-08", "2026-08-10", "unapproved_rule")
    with pytest.raises(Exception, match="unapproved"):
        deadlines.confirm(deadlines.deadlines(events, deadlines.default_rules(spark), days), "x").collect()
    easters = {r[0]: str(r[1]) for r in spark.range(2023, 2027).select("id", deadlines.easter(F.col("id"))).collect()}
    assert easters == {2023: "2023-04-09", 2024: "2024-03-31", 2025: "2025-04-20", 2026: "2026-04-05"}


def test_lockouts(spark):
    rows = [(1, t, False) for t in range(0, 50, 10)] + [(1, 60, True), (1, 101, False), (1, 5000, False), (1, 5010, True), (1, 5020, False)]
    out = ledger.lockouts(spark.createDataFrame(rows, "login long, ts long, ok boolean")).orderBy("ts").collect()
    assert [(r["outcome"], r["failed"]) for r in out] == [("failure", k) for k in range(1, 6)] + [("refused", 5), ("failure", 6), ("failure", 1), ("success", 0), ("failure", 1)]


def test_budgeted_selection(spark):
    rows = [(1, "d", p, p * 10, size, False, rank) for p, (size, rank) in enumerate([(40, None), (50, 1), (40, None), (9000, 2), (30, None)])]
    df = spark.createDataFrame(rows, "question_id long, doc_id string, position int, start int, size int, by_value boolean, rank int")
    out = [(r["start"], r["number"], r["phase"]) for r in retrieve.select_sentences(df, budget=200).orderBy("number").collect()]
    assert out == [(0, 1, 1), (10, 2, 0), (20, 3, 1), (40, 4, 1)]


def word_document(text):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        paragraphs = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in text.split("|"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def test_loaders(spark):
    content = rb"BT /F1 12 Tf 10 700 Td (Hello \(PDF\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET"
    pdf = lambda stream: b"%PDF-1.4\n1 0 obj << /Length 1 >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    wrong_page = ("zaż" * 40).encode("cp1250").decode("cp1252").encode()
    rows = {
        "a.txt": "zażółć gęślą jaźń, i tak dalej".encode("cp1250"), "a.rtf": rb"{\rtf1 Za\'bf\'f3\'b3\'e6\par next}", "a.pdf": pdf(content),
        "a.docx": word_document("one|two"), "page.txt": wrong_page, "order.md": b"a  b\r\nhyphen-\nated\n\n\n\nend ",
        "locked.pdf": b"%PDF /Encrypt 1 0 R", "a.exe": b"x", "empty.txt": b"", "no.docx": b"no zip", "junk.txt": b"\x01\x02\x03ab",
        "bad.pdf": pdf(b"BT 1.2.3 4.5.6 Td (x) Tj ET"), "scan.pdf": b"%PDF-1.4 nothing here",
    }
    frame = spark.createDataFrame([(f"/d/{n}", bytearray(d)) for n, d in rows.items()], "path string, content binary")
    out = {r["name"]: r for r in files.load_files(frame).collect()}
    assert len(out) == len(rows)
    assert out["a.txt"]["text"].startswith("zażółć") and out["a.txt"]["warnings"] == ["few characters"]
    assert out["a.rtf"]["text"] == "Zażółć\nnext" and out["a.pdf"]["text"] == "Hello (PDF)\nworld" and out["a.docx"]["text"] == "one\n\ntwo"
    assert out["page.txt"]["text"] == "zaż" * 40 and "code page repaired" in out["page.txt"]["warnings"]
    assert out["order.md"]["text"] == "a b\nhyphenated\n\nend"
    assert out["scan.pdf"]["needs_ocr"] and out["scan.pdf"]["error"] is None
    for name in ("locked.pdf", "a.exe", "empty.txt", "no.docx", "junk.txt", "bad.pdf"):
        assert out[name]["error"] and out[name]["text"] is None, name


def test_code_page_is_kept_where_the_repair_is_not_better(spark):
    from pyspark.sql import functions as F

    texts = ["", "plain", "zażółć", "costs £5 and £6 £7 £8", "¹ 中" * 30, "za¿" * 30]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", files.repair_code_page(F.col("t")).alias("r")).collect()
    assert [r["r"]["repaired"] for r in found][:3] == [False] * 3 and not found[4]["r"]["repaired"]
    assert found[5]["r"]["text"] == "zaż" * 30 and all(r["r"]["text"] == r["t"] for r in found if not r["r"]["repaired"])


def test_fragments_cut_at_the_preferred_mark():
    text = ("word " * 30 + ".\n" + "more " * 20 + "\n\n" + "x" * 400 + ". " + "y" * 900 + "\n") * 4
    for size, overlap in ((1400, 250), (300, 50), (40, 39), (7, 3)):
        spans = txt.fragment_spans(text, size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= size for a, b in spans)
        for (a, b), (c, _) in zip(spans, spans[1:]):
            assert c == max(a + 1, b - overlap)
            cuts = [text.rfind(m, a, a + size) + len(m) for m in txt.CUTS if text.rfind(m, a, a + size) - a > size / 2]
            assert b == (cuts[0] if cuts else a + size)


def test_rules_are_read_strictly():
    good = "reguly:\n  - id: a  # x\n    zdarzenie: e\n    dlugosc_dni: 7\n    liczenie: od_dnia_nastepnego\n    dni_wolne: bez_zmian\n    podstawa: \"art. 1 # 2\"\n    uwaga: >\n      one\n      two\n"
    assert rules.parse_rules(good)[0] == {"id": "a", "zdarzenie": "e", "dlugosc_dni": 7, "liczenie": "od_dnia_nastepnego", "dni_wolne": "bez_zmian", "podstawa": "art. 1 # 2", "uwaga": "one two"}
    for bad in (good.replace("    podstawa", "    unknown"), good.replace("od_dnia_nastepnego", "x"), re.sub("    dlugosc_dni.*\n", "", good)):
        with pytest.raises(rules.RuleError):
            rules.parse_rules(bad)


def test_benchmark_cleaning_breaks_lines_at_opening_tags(spark):
    rows = {
        "<p>one</p><P class='x'>two &amp; three": "one\n\ntwo & three", "no tags &amp; so": "no tags &amp; so", "a<script>x < y</script>b": "a b",
        "<b>bold</b>  \u00a0 text": "bold text", "<td>1<td>2<br/>3": "1\n2\n3", "a < b": "a < b", "": "", "<div><div><div>x": "x", None: None,
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", txt.clean_benchmark_html(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == rows


def test_a_text_is_searched_once_for_the_groups_of_a_pattern(spark):
    texts = [
        "Due 10/6/2016 and on the 6th day of October 2016, 14 days, art. 445 § 12, art. 12345", "x18 U.S.C. §§ 31422 (e), 6 Oct. 2016day 7 lata", "II Ca 12/2016 IX K 3/16 2:18-cr-004223",
        "May 5, 2016, may  5th 20161 1.2.2016.3.4.2017", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = {anchors.DAY_MONTH: 3, anchors.MONTH_DAY: 3, anchors.NUMERIC: 3, anchors.ISO: 3, anchors.DOCKET_PL: 4, anchors.DOCKET_US: 3, anchors.STATUTE_PL: 2, anchors.STATUTE_US: 3, anchors.PERIOD: 2}
    for pattern, n in patterns.items():
        plain = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, n + 1)])
        rows = df.select(anchors._matches(F.col("t"), pattern, n).alias("a"), plain.alias("b")).collect()
        assert [r["a"] and [tuple(x) for x in r["a"]] for r in rows] == [r["b"] and [tuple(x) for x in r["b"]] for r in rows], pattern
    plan = df.select(anchors.dates(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") < 12


def test_months_are_found_as_without_looking_ahead(spark):
    plain = r"(?iu)\b" + anchors._NAME + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
    assert anchors.MONTH_DAY != plain
    rnd = random.Random(8)
    names = ["Październik", "paZDZiernika", "maj", "May", "Sept", "sept.", "SEPTEMBER", "ſept", "mayor", "Junes", "december", "kwiecień", "of", "é", "x_May"]
    text = lambda: "".join(rnd.choice(names) + rnd.choice([" ", ".  ", ". ", ".", "\n", "\u00a0", "", "-"]) + rnd.choice(["2", "31st", "3rd,", "12, ", "123", ""]) + rnd.choice([" ", "", ", "]) + rnd.choice(["1996", "96", "20181 "]) + rnd.choice([" ", "", ";"]) for _ in range(12))
    texts = spark.createDataFrame([(text(),) for _ in range(400)] + [(None,), ("",)], "t string")
    both = texts.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(c) for c, p in (("x", anchors.MONTH_DAY), ("y", plain))]).collect()
    assert all(r["x"] == r["y"] for r in both) and sum(len(r["x"] or ()) for r in both) > 100
