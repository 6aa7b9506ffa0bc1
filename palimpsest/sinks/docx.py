"""Word documents of collations, written as OOXML parts: a report with notes, and a text with footnotes.

Markup is made where the rows are, as expressions; finished markup meets by collation and is zipped into a binary column.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.apparatus import golden_pieces, golden_puts
from palimpsest.shipping import ship
from palimpsest.tables import written

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006"
_RAISED = '<w:vertAlign w:val="superscript"/>'
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@dataclass(frozen=True)
class Run:
    text: str = ""
    shade: str | None = None
    raised: bool = False
    italic: bool = False
    footnote: int | None = None

    def xml(self) -> str:
        look = ("<w:i/>" if self.italic else "") + (f'<w:shd w:val="clear" w:color="auto" w:fill="{self.shade}"/>' if self.shade else "")
        if self.raised or self.footnote is not None:
            look += _RAISED
        body = f'<w:footnoteReference w:id="{self.footnote}"/>' if self.footnote is not None else "<w:br/>".join(f'<w:t xml:space="preserve">{_safe(x)}</w:t>' for x in self.text.split("\n"))
        return f"<w:r><w:rPr>{look}</w:rPr>{body}</w:r>"


def _safe(text: str) -> str:
    return escape(_ILLEGAL.sub("", text))


def _paragraph(runs: list[Run], bold: bool = False) -> str:
    body = "".join(r.xml() for r in runs)
    return f"<w:p>{body.replace('<w:rPr>', '<w:rPr><w:b/>') if bold else body}</w:p>"


def document(body: str, footnotes: list[str] = ()) -> bytes:
    """The package around the body's paragraphs and tables; footnotes are numbered from 1."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office, word = "application/vnd.openxmlformats-officedocument.wordprocessingml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    notes = "".join(f'<w:footnote w:id="{i}"><w:p><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteRef/></w:r>{Run(" " + n).xml().replace("<w:rPr>", "<w:rPr><w:sz w:val=\"16\"/>")}</w:p></w:footnote>' for i, n in enumerate(footnotes, 1))
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{_P}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{office}.document.main+xml"/><Override PartName="/word/footnotes.xml" ContentType="{office}.footnotes+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_P}/relationships"><Relationship Id="rId1" Type="{word}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="{_P}/relationships"><Relationship Id="rId1" Type="{word}/footnotes" Target="footnotes.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>{body}</w:body></w:document>',
        "word/footnotes.xml": f'{head}<w:footnotes xmlns:w="{_W}">{notes}</w:footnotes>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def report(rows: pd.DataFrame, labels: list[str]) -> bytes:
    """A column a witness, differing cells shaded and marked, then the list of notes: one collation at hand, as reports() makes many."""
    cells: list[list[Run]] = [[] for _ in labels]
    for r in rows.sort_values("row_id").itertuples():
        for w in range(len(labels)):
            if r.segs[w]:
                cells[w].append(Run(r.segs[w], shade=r.color if r.shaded[w] else None))
            if r.note and (w == 0 or r.marked[w]):
                cells[w].append(Run(f"[{int(r.note_no)}]", raised=True))
    heads = "".join(f"<w:tc>{_paragraph([Run(x)], bold=True)}</w:tc>" for x in labels)
    texts = "".join(f"<w:tc>{_paragraph(x)}</w:tc>" for x in cells)
    body = _paragraph([Run("Collation report")], bold=True) + f"<w:tbl><w:tblPr/><w:tblGrid/><w:tr>{heads}</w:tr><w:tr>{texts}</w:tr></w:tbl>" + _paragraph([Run("Notes")], bold=True)
    for r in rows[rows["note"].notna()].sort_values("row_id").itertuples():
        body += _paragraph([Run(f"{int(r.note_no)}. {r.note}")])
    return document(body)


def golden(rows: pd.DataFrame, labels: list[str], milestones: list[tuple[int, str]] = ()) -> bytes:
    """The base text with footnotes, and milestones in italics: one collation at hand, as reports() makes many."""
    runs: list[Run] = []
    notes: list[str] = []
    stones = sorted(milestones, key=lambda m: m[0])
    at = 0

    def emit(text: str) -> None:
        nonlocal at
        end = at + len(text)
        while stones and stones[0][0] < end:
            offset, tag = stones.pop(0)
            runs.extend([Run(text[: offset - at]), Run(tag, italic=True)])
            text, at = text[offset - at :], offset
        runs.append(Run(text))
        at = end

    for r in rows.sort_values("row_id").itertuples():
        base = r.segs[0]
        if isinstance(r.note, str) and r.note:
            cut = len(base) if pd.isna(r.cut) else int(r.cut)
            emit(base[:cut])
            notes.append(r.note)
            runs.append(Run(footnote=len(notes)))
            emit(base[cut:])
        else:
            emit(base)
    runs += [Run(tag, italic=True) for _, tag in stones]
    return document(_paragraph([Run(f"{labels[0]} with footnotes")], bold=True) + _paragraph([r for r in runs if r.text or r.footnote is not None]), notes)


def _xml(text: Column, look: Column | str = "") -> Column:
    """As Run(text).xml() with these properties, as an expression; nothing for an empty text."""
    safe = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for plain, escaped in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\n", '</w:t><w:br/><w:t xml:space="preserve">')):
        safe = F.replace(safe, F.lit(plain), F.lit(escaped))
    look = F.lit(look) if isinstance(look, str) else look
    return F.when(text == "", "").otherwise(F.concat(F.lit("<w:r><w:rPr>"), look, F.lit('</w:rPr><w:t xml:space="preserve">'), safe, F.lit("</w:t></w:r>")))


def _put(kind: Column, put: Column) -> Column:
    """A footnote's mark, or a milestone."""
    note = F.concat(F.lit(f'<w:r><w:rPr>{_RAISED}</w:rPr><w:footnoteReference w:id="'), put, F.lit('"/></w:r>'))
    return F.when(kind == 0, note).otherwise(_xml(put, "<w:i/>"))


def _within(tag: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


def _in_order(rows: DataFrame, by: tuple[str, ...], order: str, *columns: str) -> DataFrame:
    """by, and an array of each of columns, without nulls, in order."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r"))
    return held.select(*by, *(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull()).alias(c) for c in columns))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        both = [(document(r.report), document(r.golden, list(r.note))) for r in frame.itertuples()]
        yield pd.DataFrame({"collation_id": frame["collation_id"], "report": [x[0] for x in both], "golden": [x[1] for x in both]})


def reports(found: DataFrame, sigla: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """collation_id, report, golden: both documents of each collation of apparatus rows; sigla: collation_id, labels.

    milestones (collation_id, offset, tag) stand in the base text of the second, in italics.
    Rows become markup where they are, as expressions; a column of the report is put together by collation and witness,
    and only finished markup meets by collation, as one file holds it.  The documents are those of report() and golden().
    """
    ship(found.sparkSession)
    rows = written(found.select("collation_id", "row_id", "segs", "note", "note_no", "color", "shaded", "marked", "base_start", "cut"), "apparatus")
    mark = F.coalesce(_xml(F.concat(F.lit("["), F.col("note_no").cast("string"), F.lit("]")), _RAISED), F.lit(""))

    def cell(seg: Column, w: Column) -> Column:
        shade = F.when(F.get("shaded", w), F.concat(F.lit('<w:shd w:val="clear" w:color="auto" w:fill="'), "color", F.lit('"/>')))
        return F.concat(_xml(seg, F.coalesce(shade, F.lit(""))), F.when((w == 0) | F.get("marked", w), mark).otherwise(""))

    cells = rows.select("collation_id", "row_id", F.posexplode(F.transform("segs", cell)).alias("w", "xml"))
    columns = _in_order(cells, ("collation_id", "w"), "row_id", "xml").select("collation_id", "w", _within("w:tc", _within("w:p", F.array_join("xml", ""))).alias("column"))
    columns = _in_order(columns, ("collation_id",), "w", "column")
    entries = rows.where("note is not null").select("collation_id", "row_id", "note", _within("w:p", _xml(F.concat(F.col("note_no").cast("string"), F.lit(". "), F.col("note")))).alias("entry"))
    entries = _in_order(entries, ("collation_id",), "row_id", "note", "entry")
    pieces = golden_pieces(golden_puts(rows, milestones), _xml, _put)
    pieces = _in_order(pieces, ("collation_id",), "row_id", "piece")
    named = sigla.select("collation_id", F.transform("labels", lambda x: F.coalesce(x, F.lit(""))).alias("labels"))
    whole = columns.join(named, "collation_id").join(pieces, "collation_id").join(entries, "collation_id", "left")
    none = F.expr("cast(array() as array<string>)")
    bold = "<w:b/>"
    heads = F.array_join(F.transform("labels", lambda x: _within("w:tc", _within("w:p", _xml(x, bold)))), "")
    table = F.concat(F.lit("<w:tbl><w:tblPr/><w:tblGrid/>"), _within("w:tr", heads), _within("w:tr", F.array_join("column", "")), F.lit("</w:tbl>"))
    title, notes = (F.lit(_paragraph([Run(x)], bold=True)) for x in ("Collation report", "Notes"))
    report_body = F.concat(title, table, notes, F.array_join(F.coalesce("entry", none), ""))
    golden_body = F.concat(_within("w:p", _xml(F.concat(F.get("labels", F.lit(0)), F.lit(" with footnotes")), bold)), _within("w:p", F.array_join("piece", "")))
    bodies = whole.select("collation_id", report_body.alias("report"), golden_body.alias("golden"), F.coalesce("note", none).alias("note"))
    return bodies.mapInPandas(_packed, f"collation_id {dict(found.dtypes)['collation_id']}, report binary, golden binary")


def vote_documents(rows: DataFrame) -> DataFrame:
    """collation_id, docx: voted texts (of serialize.voted_rows) with a footnote at each differing row."""
    from palimpsest.operators.serialize import md_notes

    texts = rows.join(md_notes(rows).select("collation_id", "row_id", "note"), ["collation_id", "row_id"], "left")
    whole = texts.groupBy("collation_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "voted", "note"))).alias("r"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for cells in frame["r"]:
                notes = [c["note"] for c in cells if c["note"]]
                number = iter(range(1, len(notes) + 1))
                runs = [x for c in cells for x in ([Run(c["voted"])] + ([Run(footnote=next(number))] if c["note"] else []))]
                out.append(document(_paragraph(runs), notes))
            yield pd.DataFrame({"collation_id": frame["collation_id"], "docx": out})

    return whole.mapInPandas(make, f"collation_id {dict(whole.dtypes)['collation_id']}, docx binary")
