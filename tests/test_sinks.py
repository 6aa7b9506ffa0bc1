from __future__ import annotations

import io
import random
import zipfile
from xml.etree import ElementTree

from palimpsest.operators import apparatus as app
from palimpsest.operators import serialize
from palimpsest.plans import collation
from palimpsest.sinks import docx, files
from palimpsest.streaming.microbatch import stream_notes

ROWS = [(0, 0, "bod skad kyi/ skye <ba>"), (0, 1, "bod skad ni/ skye <ba>"), (1, 0, "a b"), (1, 1, "a c")]
SCHEMA = "collation_id long, witness_id int, text string"
TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"


def words(data: bytes, part: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "".join(t.text or "" for t in ElementTree.fromstring(z.read(part)).iter(TEXT))


def test_documents(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    found = docx.reports(collation.apparatus(frame), app.labels(frame)).orderBy("collation_id").collect()
    assert "W1 kyi] W2 ni" in words(found[0].report, "word/document.xml")
    assert words(found[0].golden, "word/document.xml").endswith("bod skad kyi/ skye <ba>")
    assert words(found[0].golden, "word/footnotes.xml") == " W1 kyi] W2 ni"
    weighted = collation.common_spelling(frame, bo=False)
    voted = docx.vote_documents(serialize.voted_rows(weighted)).orderBy("collation_id").collect()
    assert words(voted[1].docx, "word/document.xml") == "a b"


def test_milestones_of_a_document(spark):
    rows = collation.apparatus(spark.createDataFrame(ROWS, SCHEMA)).where("collation_id = 1").toPandas()
    assert words(docx.golden(rows, ["A", "B"], [(0, "[1]"), (2, "[2]"), (9, "[3]")]), "word/document.xml") == "A with footnotes[1]a [2]b[3]"


def test_files(spark, tmp_path):
    weighted = collation.common_spelling(spark.createDataFrame(ROWS, SCHEMA), bo=False)
    files.write_csv(weighted, f"{tmp_path}/csv")
    assert [r.value for r in spark.read.text(f"{tmp_path}/csv").where("collation_id = 1").collect()] == ["[a _100_],a _100_", "[b_50_],c_50_"]
    files.write_texts(serialize.plain_text(weighted), "voted_text", f"{tmp_path}/text")
    assert {r.value for r in spark.read.text(f"{tmp_path}/text").collect()} == {"bod skad kyi/ skye <ba>", "a b"}


def test_stream_of_collations(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = stream_notes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert {r.note for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"W1 kyi] W2 ni", "W1 b] W2 c"}


def test_documents_equal_those_made_by_hand(spark):
    """Every document of many edited collations, byte by byte, with milestones at marks, in gaps and past the end."""
    draw = random.Random(5)
    rows, stones = [], []
    for c in range(12):
        base = [draw.choice(["ka/", "kha", "<ga>", "nga&", "ca\n", "།", "x\x01y", "_"]) for _ in range(draw.randint(1, 40))]
        for w in range(draw.randint(2, 4)):
            told = [x for x in base if w == 0 or draw.random() < 0.8]
            told = [draw.choice(["ba", "ma "]) if w and draw.random() < 0.15 else x for x in told]
            rows.append((c, w, " ".join(told)))
        stones += [(c, o, f"[{c}.{o}]") for o in sorted(draw.sample(range(200), 8))]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = collation.apparatus(frame)
    sigla = app.labels(frame)
    held = spark.createDataFrame(stones, "collation_id long, offset int, tag string")
    table, labels = found.toPandas(), {r.collation_id: list(r.labels) for r in sigla.collect()}
    assert table["note"].notna().sum() > 50
    for milestones in (None, held):
        made = docx.reports(found, sigla, milestones).collect()
        assert len(made) == table["collation_id"].nunique()
        for r in made:
            own = table[table["collation_id"] == r.collation_id]
            placed = [(o, t) for c, o, t in stones if c == r.collation_id] if milestones is not None else []
            assert bytes(r.report) == docx.report(own, labels[r.collation_id])
            assert bytes(r.golden) == docx.golden(own, labels[r.collation_id], placed)
