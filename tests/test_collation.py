from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import preprocess, tibetan
from palimpsest.functions.readings import comparison_key, display, note_text, syllables, trimmed
from palimpsest.functions.tokens import GENERIC, TIBETAN, decode, encode, tokens
from palimpsest.functions.valid_syllable import valid_weight
from palimpsest.operators import annotations, serialize
from palimpsest.operators import apparatus as app
from palimpsest.operators.align import align, reattach_achung, token_arrays
from palimpsest.operators.diff import edit_script, edit_scripts, placements
from palimpsest.operators.layout import long_rows, witness_rows
from palimpsest.operators.merge import fold, merge_rows
from palimpsest.operators.weigh import Weigher, combined, count_weight, vote, weigh
from palimpsest.options import Options
from palimpsest.plans import collation
from palimpsest.sources import witnesses as sources


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_script_is_minimal_and_complete(a, b):
    script = edit_script(a, b)
    assert sum(n for op, n in script if op == "=") == lcs(a, b)
    i = j = 0
    for op, n in script:
        if op == "=":
            assert a[i : i + n] == b[j : j + n]
        i += n * (op != "+")
        j += n * (op != "-")
    assert (i, j) == (len(a), len(b))
    assert len(placements(script)) == len(b)
    assert sum(n for op, n in edit_script(b, a) if op == "=") == lcs(a, b)


def test_script_of_long_unlike_texts_is_complete():
    rng = random.Random(1)
    a, b = ([rng.randrange(3000) for _ in range(4000)] for _ in range(2))
    script = edit_script(a, b)
    assert sum(n for op, n in script if op != "+") == len(a) and sum(n for op, n in script if op != "-") == len(b)


def test_placement_keeps_every_token():
    assert placements(edit_script("AC", "XYC")) == [(0, 0), (0, 1), (1, 0)]  # no token is lost at the start
    assert placements(edit_script("C", "XYC")) == [(-1, -2), (-1, -1), (0, 0)]
    assert placements(edit_script("ABCD", "AXD")) == [(0, 0), (2, 0), (3, 0)]  # surplus deletes come first


PRE_MERGE = [
    ("The quick brown fox jumped over the lazy dog.", "The brown fox jumped over the very lazy dog.",
     "The |quick |brown |fox |jumped |over |the |-|lazy |dog|.", "The |-|brown |fox |jumped |over |the |very |lazy |dog|."),
    ("quick brown fox jumped over the lazy dog.", "The quick brown fox jumped over the very lazy dog.",
     "-|quick |brown |fox |jumped |over |the |-|lazy |dog|.", "The |quick |brown |fox |jumped |over |the |very |lazy |dog|."),
    ("the fast", "the quick", "the |fast", "the |quick"),
    ("the", "the quick", "the|-", "the |quick"),
]


def test_layout_before_the_merge(spark):
    rows = [(i, w, text) for i, case in enumerate(PRE_MERGE) for w, text in enumerate(case[:2])]
    wide = align(spark.createDataFrame(rows, "collation_id long, witness_id int, text string"), merged=False).orderBy("collation_id", "row_id").collect()
    for i, case in enumerate(PRE_MERGE):
        for w in (0, 1):
            assert "|".join("-" if r.cells[w] is None else r.cells[w].text for r in wide if r.collation_id == i) == case[2 + w]


def test_merge_of_a_three_witness_matrix(spark):
    """Codes of 20, 19 and 15 tokens; 14 merged rows."""
    texts = [list("+,-./0123456789678-3"), list(",-./012345678:678-3"), list(";-./456789678-3")]
    tokens_of = [*texts[:2], [*texts[2][:10], "6*", *texts[2][11:]]]  # one token of equal code is spelled otherwise
    arrays = spark.createDataFrame([(0, w, t, tokens_of[w]) for w, t in enumerate(texts)], "collation_id long, witness_id int, norms array<string>, tokens array<string>")
    from palimpsest.operators.diff import place
    from palimpsest.operators.layout import layout, wide_rows

    rows = merge_rows(wide_rows(layout(place(arrays)))).orderBy("row_id").collect()
    found = [tuple(c.text for c in r.cells) for r in rows]
    assert found[0] == ("+,", ",", ";") and found[1] == ("-", "-", "-")
    assert found[3] == ("/0123", "/0123", "/")
    assert found[9] == ("96", ":6", "96*")
    assert len(found) == 14
    for w, text in enumerate(tokens_of):
        assert "".join(x[w] for x in found) == "".join(text)


def fold_by_hand(rows):
    out = []
    for row in rows:
        apart = lambda r: len({c or "" for c in r}) > 1
        if out and (None in row or apart(out[-1]) and apart(row)):
            out[-1] = [p + (c or "") for p, c in zip(out[-1], row, strict=True)]
        else:
            out.append([c or "" for c in row])
    return out


def test_fold(spark):
    rng = random.Random(9)
    cases = [[["ab", "a"], [None, "b"], ["x", "y"]]] + [[[rng.choice([None, "a", "b"]) for _ in range(2)] for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    cell = "array<array<struct<start:int,end:int,incr:int,text:string>>>"
    frame = spark.createDataFrame([(i, [[None if c is None else (0, 1, 1, c) for c in r] for r in rows]) for i, rows in enumerate(cases)], f"i int, rows {cell}")
    for r in frame.select("i", fold(F.col("rows")).alias("x")).collect():
        assert [[c.text for c in row] for row in r.x] == fold_by_hand(cases[r.i])
    assert fold_by_hand(cases[0]) == [["ab", "ab"], ["x", "y"]]  # a merge may turn a differing row into an equal one


def test_round_trip_and_self_alignment(spark):
    rng = random.Random(5)
    words = ["ka ", "kha ", "ga", " nga", "'", "-", "/ ", "_", "ཀ་", "ཁ", "\n", "  "]
    rows = [(i, w, "".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(40) for w in range(4)]
    rows += [(99, w, "the same text here") for w in range(3)] + [(100, 0, ""), (100, 1, ""), (101, 0, None), (101, 1, "a b")]
    frame = spark.createDataFrame(rows, "collation_id long, witness_id int, text string")
    for merged in (True, False):
        wide = align(frame, merged=merged)
        found = {}
        for r in wide.orderBy("collation_id", "row_id").collect():
            for w, c in enumerate(r.cells):
                found[r.collation_id, w] = found.get((r.collation_id, w), "") + (c.text if c else "")
                if merged:
                    assert c is not None
        for i, w, text in rows:
            assert found.get((i, w), "") == (text or ""), (i, w, merged)
    assert align(frame.where("collation_id = 99")).where(F.size(F.array_distinct(F.transform("cells", lambda c: c["text"]))) > 1).count() == 0
    assert align(frame.where("collation_id = 100")).count() == 0


def test_tibetan_tokens_and_codes(spark):
    text = "བཀྲ་ཤིས་ཀུན་གྱི་བཀྲ་ཤིས་པ།"
    frame = spark.createDataFrame([(0, 0, text)], "collation_id long, witness_id int, text string")
    table = tokens(frame, TIBETAN, norm=collation.tibetan_norm)
    rows = table.orderBy("pos").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 4), (4, 8), (8, 12), (12, 16), (16, 20), (20, 24), (24, 25), (25, 26)]
    assert all(r.incr == 1 for r in rows)
    codes = {r.norm: r.code for r in encode(table).collect()}
    seen = []
    pattern = [seen.index(c) if c in seen else (seen.append(c), len(seen) - 1)[1] for c in (codes[r.norm] for r in rows)]
    assert pattern == [0, 1, 2, 3, 0, 1, 4, 5]


CHAIN = [("། །", "༎ "), ("༌", "་"), ("་ +", "་")]
LONG = "གི་ཚེ་རང་ཉིད༌        ཉིད་སྐྱེ་ན་རྒྱུའི། །"


def test_filter_chain_and_offsets(spark):
    frame = spark.createDataFrame([(0, 0, LONG)], "collation_id long, witness_id int, text string")
    row = preprocess.filter_chain(frame, "text", CHAIN)
    assert row.first().filtered == "གི་ཚེ་རང་ཉིད་ཉིད་སྐྱེ་ན་རྒྱུའི༎ "
    table = tokens(row.select("collation_id", "witness_id", F.col("filtered").alias("text")), TIBETAN, norm=collation.tibetan_norm)
    spans = table.join(row.select("maps")).select("pos", preprocess.corrected_chain(F.col("start"), F.col("maps")).alias("a"), preprocess.corrected_chain(F.col("end"), F.col("maps")).alias("b")).orderBy("pos").collect()
    assert [(r.a, r.b) for r in spans] == [(0, 3), (3, 6), (6, 9), (9, 21), (21, 25), (25, 30), (30, 32), (32, 38), (38, 41)]


def test_a_longer_replacement_maps_each_new_character(spark):
    found = one(spark, preprocess.apply_pattern(F.col("t"), "x", "abc"), t="1x2x")
    assert found.text == "1abc2abc" and [tuple(p) for p in found.map] == [(2, -1), (3, -2), (6, -3), (7, -4)]


@pytest.mark.parametrize("text, want", [("[1a] ka [2b]kha", [(0, "[1a]"), (5, "[2b]")]), ("none", []), ("", []), ("[a][b]", [(0, "[a]"), (1, "[b]")]), ("a[" + "x" * 41 + "]", [])])
def test_milestones(spark, text, want):
    assert [tuple(m) for m in one(spark, preprocess.milestones(F.col("t")), t=text)] == want
    stripped = one(spark, preprocess.strip_tags(F.col("t")), t=text)
    assert all(stripped[o] == " " for o, _ in want)


def test_hits_and_preview(spark):
    assert one(spark, preprocess.preview(F.col("t")), t="[1] a_b|c@d#!") == "folio/page tags [..]: 1, underscores _: 1, pipes |: 1, head marks @ # !: 3"
    assert one(spark, preprocess.preview(F.col("t")), t="plain") == "nothing to clean"


@pytest.mark.parametrize("form, want", [("དག", "དག"), ("གའམ", "ག"), ("དགའ", "དགའ"), ("དགའི", "དགའ"), ("ཀུནད", "ཀུན"), ("འོནད", "འོན")])
def test_affixes(spark, form, want):
    assert one(spark, tibetan.remove_affixes(F.col("s")), s=form) == want


@pytest.mark.parametrize("form, want, valid", [
    ("ཀཾཱོུ", "ཀཱོུཾ", True),
    ("སོྱ", "སྱོ", True),
    ("་ཾ", "་ཾ", False),
])
def test_unicode_order(spark, form, want, valid):
    assert one(spark, tibetan.normalize_unicode(F.col("s")), s=form) == want
    assert one(spark, tibetan.unicode_valid(F.col("s")), s=form) is valid


def test_old_spellings_graphical_and_lenient_forms(spark):
    assert one(spark, tibetan.normalize_old(F.col("s")), s="དྲངསྟེ") == "དྲངས་ཏེ"
    assert one(spark, tibetan.normalize_old(F.col("s")), s="གགྀ་") == "གག་གྀ་"
    assert one(spark, tibetan.normalize_graphical(F.col("s")), s="༌༎ེེ") == "་།།ཻ"
    assert one(spark, tibetan.normalize_lenient(F.col("s")), s="ཊྀྂ") == "ཏིཾ"
    assert one(spark, tibetan.normalize_blanks(F.col("s")), s="a  b\r\nc") == "a b\nc"
    assert one(spark, tibetan.normalize_blanks(F.col("s"), False), s=" a  b\n c\nd ") == "a bc d "


def test_substitutions(spark, tmp_path):
    path = tmp_path / "subst.csv"
    path.write_text("ཀ,ཁ\nག,ང\nalone\nཀ,ཅ\nསྷོ,སོ", encoding="utf-8")  # no line end at the end: the last row is whole
    table = sources.read_substitutions(spark, str(path))
    assert {r.form: r.lemma for r in table.collect()} == {"ཀ": "ཅ", "ག": "ང", "སྷོ": "སོ"}
    words = spark.createDataFrame([("ཀ",), ("ང",), ("གའི",), ("ག་",)], "token string")
    assert {r.token: r.norm for r in tibetan.normalize_vocabulary(words, table).collect()} == {"ཀ": "ཅ", "ང": "ང", "གའི": "ང", "ག་": "ང"}
    assert {r.token: r.norm for r in tibetan.normalize_vocabulary(words, table, semantic=False).collect()} == {"ཀ": "ཀ", "ང": "ང", "གའི": "གའི", "ག་": "ག"}
    texts = spark.createDataFrame([(0, 0, "ཀ་མི་ང"), (0, 1, "ཅ་མྱི་གའི")], "collation_id long, witness_id int, text string")

    def rows(**more):
        cells = collation.common_spelling(texts, **more).orderBy("row_id", "witness_id").collect()
        return [[c.text for c in cells if c.row_id == r] for r in sorted({c.row_id for c in cells})]

    def scripts(**more):
        vocabulary = lambda v: tibetan.normalize_vocabulary(v, **more)
        return [[(s.op, s.n) for s in r.script] for r in edit_scripts(token_arrays(texts, TIBETAN, vocabulary=vocabulary)).collect()]

    assert scripts(substitutions=table, old=True) == [[("=", 3)]]
    assert scripts(old=True) == [[("-", 1), ("+", 1), ("=", 1), ("-", 1), ("+", 1)]]
    assert scripts() == [[("-", 3), ("+", 3)]]
    assert rows(substitutions=table, old=True) == [["ཀ་མི་ང", "ཅ་མྱི་གའི"]]


def test_offsets_of_a_whole_pipeline_are_those_before_the_filters(spark):
    frame = spark.createDataFrame([(0, 0, LONG), (0, 1, LONG)], "collation_id long, witness_id int, text string")
    cells = collation.common_spelling(frame, CHAIN).where("witness_id = 1").orderBy("row_id").collect()
    assert [(c.start, c.end) for c in cells] == [(0, 3), (3, 6), (6, 9), (9, 21), (21, 25), (25, 30), (30, 32), (32, 38), (38, 41)]
    table = tokens(preprocess.filter_chain(frame, "text", CHAIN).where("witness_id = 0").withColumn("text", F.col("filtered")), TIBETAN, norm=collation.tibetan_norm, maps="maps")
    assert [(r.start, r.end) for r in table.orderBy("pos").collect()] == [(c.start, c.end) for c in cells]


def test_a_function_may_replace(spark):
    found = one(spark, preprocess.apply_pattern(F.col("t"), "[a-z]+", lambda m: F.concat(F.upper(m), F.lit("!"))), t="1 ab 2 c")
    assert found.text == "1 AB! 2 C!" and [tuple(p) for p in found.map] == [(4, -1), (9, -2)]


def test_decode_is_the_inverse(spark):
    frame = spark.createDataFrame([(0, "b"), (0, "a"), (0, ""), (1, "c")], "collation_id long, norm string")
    codes = encode(frame)
    asked = codes.select("collation_id", "code").unionByName(spark.createDataFrame([(0, 0), (1, 9)], "collation_id long, code int"))
    assert sorted((r.collation_id, r.code, r.norm or "") for r in decode(asked, codes).collect()) == [(0, 0, ""), (0, 1, "a"), (0, 2, "b"), (1, 1, "c"), (1, 9, "")]


def test_another_aligner(spark):
    def in_order(arrays):
        cells = arrays.select("collation_id", "witness_id", F.posexplode("tokens").alias("anchor", "text"))
        return cells.select("collation_id", "witness_id", "anchor", F.lit(0).alias("slot"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1).alias("incr"), "text")

    frame = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "x a b c")], "collation_id long, witness_id int, text string")
    texts = [[c.text for c in r.cells if c] for r in align(frame, merged=False, aligner=in_order).orderBy("row_id").collect()]
    assert texts == [["a ", "x "], ["b ", "a "], ["c", "b "], ["c"]]

@pytest.mark.parametrize("syllable, want", [("བཀྲ་", 100), ("ཤིས", 100), ("དཀ", 70), ("དགའ", 100), ("ཀཀཀ", 70), ("abc", None), ("བརྡའ", 100), ("ཀའུ", 70), ("ཀའུའི", 100)])
def test_valid_syllables(spark, syllable, want):
    assert one(spark, valid_weight(F.col("s")), s=syllable) == want


ROWS = [["བཀྲ་"] * 3, ["ཤིས་"] * 3, ["ཀུན་", "ཀུད་", "ཀུད་"], ["གྱི་", "གྱི་", "ཀྱི་"], ["བཀྲ་"] * 3, ["ཤིས་"] * 3, ["པའི", "པའི", "པས"], ["།"] * 3]


@pytest.fixture(scope="module")
def weighted(spark):
    cells = [(0, r, w, 0, 0, 1, t) for r, row in enumerate(ROWS) for w, t in enumerate(row)]
    frame = spark.createDataFrame(cells, "collation_id long, row_id int, witness_id int, start int, end int, incr int, text string")
    return weigh(frame, [Weigher(count_weight())]).cache()


def test_count_weights_and_votes(weighted):
    found = {(r.row_id, r.witness_id): r.weight for r in weighted.collect()}
    assert [found[2, w] for w in range(3)] == [33, 66, 66] and [found[3, w] for w in range(3)] == [66, 66, 33] and found[0, 0] == 100
    assert {r.row_id: r.top for r in vote(weighted).collect()}[2] == 1


def test_serializers(spark, weighted):
    assert serialize.plain_text(weighted).first().voted_text == "བཀྲ་ཤིས་ཀུད་གྱི་བཀྲ་ཤིས་པའི།"
    entries = {(r.row_id, r.witness_id): r.entry for r in serialize.csv_entries(weighted).collect()}
    assert [entries[2, w] for w in range(3)] == ["ཀུན་_33_", "[ཀུད་_66_]", "ཀུད་_66_"]
    names = spark.createDataFrame([(0, 0, "Derge"), (0, 1, "Lhasa"), (0, 2, "Narthang")], "collation_id long, witness_id int, name string")
    rows = serialize.voted_rows(weighted, names, {"Derge": "D", "Narthang": "N"})
    assert serialize.markdown(rows).first().md == (
        "བཀྲ་ཤིས་ཀུད་[^1]གྱི་[^2]བཀྲ་ཤིས་པའི[^3]།\n\n[^1]: ཀུད་]D: ཀུན་; N: ཀུད་;\n[^2]: གྱི་]D: གྱི་; N: ཀྱི་;\n[^3]: པའི]D: པའི; N: པས;\n"
    )
    assert serialize.markdown(serialize.voted_rows(weighted)).first().md.startswith("བཀྲ་ཤིས་ཀུད་[^1]")
    lines = [r.line for r in serialize.csv_lines(weighted).orderBy("row_id").collect()]
    assert lines[0] == "[བཀྲ་_100_],བཀྲ་_100_,བཀྲ་_100_"


def test_inline_notes_skip_rows_where_all_serialised_agree(spark):
    rows = [["བཀྲ་"] * 5, ["ཤིས་"] * 5, ["ཀུན་", "ཀུད་", "ཀུད་", "ཀུད་", "ཀུད་"], ["གྱི་", "གྱི་", "གྱི་", "གྱི་", "ཀྱི་"], ["བཀྲ་ཤིས་པས", "བཀྲ་ཤིས་པས", "བཀྲ་ཤིས་པས", "བཀྲ་ཤིས་པའི", "བཀྲ་ཤིས་པས"], ["།"] * 5]
    cells = [(0, r, w, t) for r, row in enumerate(rows) for w, t in enumerate(row)]
    frame = weigh(spark.createDataFrame(cells, "collation_id long, row_id int, witness_id int, text string"), [Weigher(count_weight())])
    names = spark.createDataFrame([(0, w, n) for w, n in enumerate("ABCDE")], "collation_id long, witness_id int, name string")
    found = serialize.hfml(serialize.voted_rows(frame, names, {"A": "«a»", "D": "«d»"})).first().hfml
    assert found == "བཀྲ་ཤིས་ཀུད་(1) <«a»ཀུན་>གྱི་:བཀྲ་ཤིས་པས(2) <«d»བཀྲ་ཤིས་པའི>།"


def test_combined_weights(spark):
    def value(*weighers):
        return one(spark, combined([Weigher(F.lit(w).cast("int"), s, r) for w, s, r in weighers]))

    assert value((80, 1, False), (50, 1, True)) == 40
    assert value((80, 1, False), (40, 3, False)) == 50
    assert value((80, 1, False), (None, 1, True)) == 80
    assert value((80, 1, False), (0, 1, True)) == 80
    assert value((None, 1, False), (50, 1, True)) is None
    assert value((None, 1, True)) is None


NOTES = [
    (["gyur kyi ", "gyur ni ", "gyur ni "], False, "BX1 kyi] GX1, GB1 ni"),
    (["la ", "la ", "pa "], True, "BX1, GX1 la] GB1 pa"),
    (["kyi ", "", "kyi "], False, "BX1 kyi] GX1 om."),
    (["", "ka ", "kha "], False, "BX1 om.] GX1 ka; GB1 kha"),
    (["same", "same ", "same/"], False, ""),
    (["gyur", "'gyur", "gyur"], False, "BX1 gyur] GX1 'gyur"),
    (["བཀྲ་ཤིས་པ", "བཀྲ་ཤིང་མ་པ", "བཀྲ་ཤིས་པ"], False, "BX1 ཤིས] GX1 ཤིང་མ"),
]


@pytest.mark.parametrize("segs, positive, want", NOTES)
def test_notes(spark, segs, positive, want):
    o = Options(positive=positive)
    row = spark.createDataFrame([(segs,)], "s array<string>")
    row = row.select(F.transform("s", lambda x: comparison_key(x, o)).alias("k"), F.transform("s", lambda x: syllables(x, o)).alias("y"))
    row = row.withColumn("d", F.transform(trimmed(F.col("y")), display))
    assert row.select(note_text(F.array(*map(F.lit, o.sigla)), F.col("k"), F.col("d"), positive).alias("n")).first().n == want


def test_a_chung(spark):
    def moved(*cells):
        return one(spark, reattach_achung(F.array(*(F.lit(c) for c in cells)), Options()))

    assert moved("su '", "gyur") == ["su ", "'gyur"]
    assert moved("dga'", "ba") == ["dga'", "ba"]
    assert moved("/ /'", None, "", "dir") == ["/ /", None, "", "'dir"]
    assert moved("'", "'", "a") == ["", "", "''a"]
    assert moved("ka '", "") == ["ka '", ""]
    assert one(spark, syllables(F.lit("' gyur ' la"), Options())) == ["'gyur'", "la"]


def test_apparatus_and_golden_text(spark):
    rows = [(0, 0, "BX1", "[1a]bod skad kyi/ skye ba"), (0, 1, "GX1", "bod skad ni/ skye ba"), (0, 2, "GB1", "bod skad kyi/ skye a-ba")]
    frame = spark.createDataFrame(rows, "collation_id long, witness_id int, siglum string, text string")
    found = collation.apparatus(frame).orderBy("row_id").collect()
    listed = [r.note for r in found if r.differs]
    assert [r.note_no for r in found if r.differs] == list(range(1, len(listed) + 1)) and "BX1 kyi] GX1 ni" in listed
    assert all(r.color == "FFD37F" for r in found if r.note_no == 1)
    text = collation.golden_text(frame).first().golden
    assert text.startswith("[1a] ") and "kyi[^1]/ " in text
    plain = text.replace("[1a]", "")
    for i in range(1, len(listed) + 1):
        plain = plain.replace(f"[^{i}]", "")
    assert plain == " bod skad kyi/ skye ba"


def test_hyphens_and_positive_shads_are_kept(spark):
    frame = spark.createDataFrame([(0, 0, "a-b c / d"), (0, 1, "a b c d")], "collation_id long, witness_id int, text string")
    found = collation.apparatus(frame, Options(ignore_shad=False, positive=True)).collect()
    assert any(r.differs and "-" in r.note for r in found)
    shad = next(r for r in found if r.differs and "/" in r.lemma)
    assert shad.segs[0][: shad.cut].endswith("/")


def test_votes_of_a_whole_pipeline(spark):
    rows = [(0, w, n, t) for w, (n, t) in enumerate([("a", "བཀྲ་ཤིས་ཀུན་།"), ("b", "བཀྲ་ཤིས་ཀུད་།"), ("c", "བཀྲ་ཤིས་ཀུད་།")])]
    frame = spark.createDataFrame(rows, "collation_id long, witness_id int, name string, text string")
    found = collation.common_spelling(frame, CHAIN)
    assert serialize.plain_text(found).first().voted_text == "བཀྲ་ཤིས་ཀུད་།"


def test_confidences(spark):
    cells = spark.createDataFrame([(0, 0, 0, 5, "a"), (0, 0, 5, 200, "b"), (0, 0, 200, 201, "c"), (0, 0, 201, 201, None)], "collation_id long, witness_id int, start int, end int, text string")
    marks = spark.createDataFrame([(0, 0, 0, 0.1), (0, 0, 5, 0.9), (0, 0, 150, 0.555)], "collation_id long, witness_id int, start int, confidence double")
    found = {r.start: r.confidence for r in annotations.confidence_min(cells, marks).where("text is not null").collect()}
    assert found == {0: 90, 5: 55, 200: 100}
    layer = spark.createDataFrame([(0, 0, 3, 0.5, 0), (0, 0, 4, 0.6, 1), (0, 9, 12, 0.7, 2)], "witness_id int, start int, end int, confidence double, ord int")
    segs = spark.createDataFrame([(0, 2, 8)], "witness_id int, seg_start int, seg_end int")
    assert [(r.start, r.confidence) for r in annotations.scan_layer(layer, segs).collect()] == [(0, 0.6)]
    voted = spark.createDataFrame([(0, 0, "ka", 90, "p1"), (0, 1, "kha", None, "p1"), (0, 2, "ga", 50, "p2")], "collation_id long, row_id int, voted string, confidence int, page string")
    base, spans = annotations.confidence_layer(voted)
    assert base.first().base == "kakha\n\nga\n\n"
    assert {(r.kind, r.start, r.end) for r in spans.collect()} == {("ocr_confidence", 0, 2), ("ocr_confidence", 7, 9), ("pagination", 0, 5), ("pagination", 7, 9)}


def test_version_files(spark, tmp_path):
    for name, text in (("b.txt", "ཀ\u0f0d \u0f0bཁ"), ("a.txt", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {r.name: r for r in sources.read_versions(spark, str(tmp_path)).collect()}
    assert found["a"].witness_id == 0 and found["b"].text == "ཀ\u0f0d \u0f0dཁ"
    exemplar = sources.number(sources.read_versions(spark, str(tmp_path)).drop("witness_id"), "b")
    assert {r.name: r.witness_id for r in exemplar.collect()} == {"b": 0, "a": 1}
    up = sources.read_upload(spark, str(tmp_path / "b.txt"), str(tmp_path / "a.txt"))
    assert [r.siglum for r in up.orderBy("witness_id").collect()] == ["BX1", "GX1"]


def test_transposition_is_the_inverse(spark):
    frame = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "a x c d")], "collation_id long, witness_id int, text string")
    cells = long_rows(align(frame))
    for r in witness_rows(cells).collect():
        assert "".join(c.text for c in r.cells) == ["a b c", "a x c d"][r.witness_id]


def test_texts_by_name(spark):
    rows = [tuple(r)[1:] for r in collation.collate_texts(spark, {"one": "the brown fox", "two": "the quick fox jumps"}).collect()]
    assert rows == [("the ", "the "), ("brown ", "quick "), ("fox", "fox "), (None, "jumps")]


def test_scans_are_merged_by_confidence(spark):
    frame = spark.createDataFrame([(0, 0, "one two tree"), (0, 1, "one two three"), (0, 2, "one to three")], "collation_id long, witness_id int, text string")
    marks = spark.createDataFrame([(0, 0, 10, 0.2), (0, 1, 10, 0.9), (0, 2, 9, 0.5)], "collation_id long, witness_id int, start int, confidence double")
    base, spans = collation.merge_scans(frame, marks, GENERIC, lambda t: F.regexp_replace(F.lower(t), r"\s+$", ""))
    assert base.first().base == "one two three"
    assert {r.kind for r in spans.collect()} == {"ocr_confidence"}
