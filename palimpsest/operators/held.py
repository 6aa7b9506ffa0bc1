"""Collations whose texts meet in a row: aligned, laid out and merged many at once, over numbers.

Tokens are numbers by their norms and by their texts.  Cells follow each other in their text, so a cell of any row, merged or
not, is a stretch of it: rows are boundaries, and texts are cut once, as rows go out.  Only edit scripts of texts that differ
by more than own tokens go token by token.  What is held at once is bounded: GROUP tokens, or a collation, and CELLS cells that go out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.operators.cells import counted, votes
from palimpsest.operators.diff import edit_script, middle_steps, placements

GROUP = 1 << 17
CELLS = 1 << 15
CELL = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("incr", pa.int32()), ("text", pa.string())])


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading numbers agree."""
    apart = a[: len(b)] != b[: len(a)]
    return int(apart.argmax()) if apart.any() else len(apart)


def matched(a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the tokens that a minimal script keeps, as diff.edit_script() has it; mark: false for every number."""
    n, m = len(a), len(b)
    head = _same(a, b)
    tail = _same(a[head:][::-1], b[head:][::-1])
    x, y = a[head : n - tail], b[head : m - tail]
    i = j = np.zeros(0, np.int64)
    if len(x) and len(y):
        mark[x] = True
        in_x = mark[y]
        mark[x] = False
        mark[y] = True
        in_y = mark[x]
        mark[y] = False
        i, j = np.flatnonzero(in_y), np.flatnonzero(in_x)
        # texts that agree in all tokens that both have are kept in these
        if len(i) != len(j) or (x[i] != y[j]).any():
            steps = np.array(middle_steps(x.tolist(), y.tolist()))
            kept = steps == "="
            i, j = ((np.cumsum(steps != other) - 1)[kept] for other in "+-")
    ends = np.arange(tail)
    return np.r_[np.arange(head), head + i, n - tail + ends], np.r_[np.arange(head), head + j, m - tail + ends]


def placed(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """anchor and slot of each of m tokens, as diff.placements() has them, of the places kept in n and m."""
    i, j = np.r_[i, n], np.r_[j, m]
    before = np.r_[-1, j[:-1]]
    plus, minus = j - before - 1, np.diff(np.r_[-1, i]) - 1
    run = np.repeat(np.arange(len(i)), plus + 1)[:m]
    at = np.arange(m) - before[run] - 1
    pairs, plus, base = np.minimum(minus, plus)[run], plus[run], i[run]
    same, paired = at == plus, at < pairs
    anchors = np.where(same, base, np.where(paired, base - pairs + at, base - 1))
    slots = np.where(same | paired, 0, np.where(base > 0, at - pairs + 1, at - plus))
    return anchors, slots


class Rows:
    """The rows of some collations, of their distinct texts.

    tokens: lists by collation of lists by text; the first text is the base.  words, norms: each collation's distinct tokens and their norms.
    chars: by collation, where each text's tokens begin in a longer text.
    """

    def __init__(self, tokens: pa.ListArray, words: pa.ListArray, norms: pa.ListArray, merged: bool = True, cleanup: str | None = None, chars: pa.ListArray | None = None) -> None:
        texts = tokens.flatten()
        flat = texts.flatten()
        self.many = _sizes(tokens)  # texts a collation
        self.first_text = _before(self.many)
        self.of_text = np.repeat(np.arange(len(tokens)), self.many)
        sizes = _sizes(texts)
        norm = norms.flatten().dictionary_encode()
        codes, own, empty = self._numbered(flat, words.flatten(), norm)
        codes = self._cells(flat, sizes, codes, own, empty)
        if chars is not None:
            moved = chars.flatten().to_numpy(zero_copy_only=False)[self.text]
            self.start, self.end = self.start + moved, self.end + moved
        self._place(norm.dictionary, cleanup)
        self._lay_out()
        new = self._merge(codes) if merged else np.ones(self.n_rows, bool)
        self._group(new, merged)

    @staticmethod
    def _numbered(flat: pa.StringArray, words: pa.StringArray, norm: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, int]:
        found = flat.dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.full(len(found.dictionary), len(norm.dictionary), np.int64)
        number[pc.index_in(words, value_set=found.dictionary).to_numpy(zero_copy_only=False)] = pc.fill_null(norm.indices, len(norm.dictionary)).to_numpy(zero_copy_only=False)
        return codes, number[codes], norm.dictionary.index("").as_py()

    def _cells(self, flat: pa.StringArray, sizes: np.ndarray, codes: np.ndarray, own: np.ndarray, empty: int) -> np.ndarray:
        """Cells of tokens: one of empty norm joins the cell before it, or the first; returns numbers of their texts."""
        n, n_texts = len(flat), len(sizes)
        text = np.repeat(np.arange(n_texts), sizes)
        live = own != empty
        self.live = sizes
        self.dead = np.zeros(0, np.int64)
        if live.all():
            begin, self.norm = np.arange(n), own
        else:
            self.live = np.bincount(text[live], minlength=n_texts)
            upto = np.cumsum(live)
            nth = upto - _before(self.live)[text]
            opens = live & (nth > 1)
            opens[_before(sizes)[sizes > 0]] = True
            begin = np.flatnonzero(opens)
            # a text without a norm is one cell that takes no part
            none = self.live[text[begin]] == 0
            self.dead = np.flatnonzero(none)
            self.norm = np.full(len(begin), -1, np.int64)
            self.norm[~none] = own[live]
        self.text = text[begin]
        self.n_cells = np.bincount(self.text, minlength=n_texts)
        self.first_cell = _before(self.n_cells)
        bounds = np.r_[begin, n]
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1] if n else np.zeros(1, np.int32)
        self.bytes, self.data = offsets[bounds], flat.buffers()[2]
        chars = np.r_[0, np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64))]
        at = chars[_before(sizes)][self.text]
        self.start, self.end = chars[bounds[:-1]] - at, chars[bounds[1:]] - at
        self.incr = np.ones(len(begin), np.int32)
        self.incr[self.dead] = 0
        return codes if len(begin) == n else self._strings(self.bytes).dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def _strings(self, offsets: np.ndarray) -> pa.StringArray:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), self.data if self.data is not None else pa.py_buffer(b""))

    def _place(self, names: pa.StringArray, cleanup: str | None) -> None:
        told = [*names.to_pylist(), None] if cleanup else []
        self.anchor = np.arange(len(self.text)) - self.first_cell[self.text]
        self.slot = np.zeros(len(self.text), np.int64)
        self.anchor[self.dead] = self.slot[self.dead] = -1
        mark = np.zeros(int(self.norm.max(initial=0)) + 1, bool)
        bases = self.first_text[self.of_text]
        for t in np.flatnonzero((bases != np.arange(len(bases))) & (self.live > 0)).tolist():
            n, m, at = int(self.live[bases[t]]), int(self.live[t]), int(self.first_cell[t])
            a, b = self.norm[self.first_cell[bases[t]] :][:n], self.norm[at : at + m]
            if n == m and (a == b).all():
                continue
            if cleanup:
                found = np.array(placements(edit_script([told[x] for x in a.tolist()], [told[x] for x in b.tolist()], cleanup))).T
            else:
                found = placed(*matched(a, b, mark), n, m)
            self.anchor[at : at + m], self.slot[at : at + m] = found

    def _lay_out(self) -> None:
        span = self.live[self.first_text] + 1
        first = _before(span)
        at = first[self.of_text[self.text]] + self.anchor + 1
        need = np.where(self.slot < 0, -self.slot, self.slot + 1)
        widths = np.zeros(int(span.sum()), np.int64)
        widths[at] = 1
        more = need > 1
        np.maximum.at(widths, at[more], need[more])
        self.row = _before(widths)[at] + np.where(self.slot < 0, widths[at] + self.slot, self.slot)
        self.n_rows = int(widths.sum())
        own = np.add.reduceat(widths, first) if len(first) else widths
        self.of_row = np.repeat(np.arange(len(own)), own)
        self.first_row = _before(own)

    def _merge(self, codes: np.ndarray) -> np.ndarray:
        """Rows that begin an output row, as operators.merge says."""
        full = np.bincount(self.row, minlength=self.n_rows) == self.many[self.of_row]
        base = np.full(self.n_rows, -1, np.int64)
        first = self.text == self.first_text[self.of_text[self.text]]
        base[self.row[first]] = codes[first]
        apart = np.zeros(self.n_rows, bool)
        apart[self.row[codes != base[self.row]]] = True
        equal, differs = full & ~apart, full & apart
        head = np.r_[True, self.of_row[1:] != self.of_row[:-1]] if self.n_rows else equal
        new = equal | head | differs & np.r_[False, equal[:-1]][: self.n_rows]
        self.alike = equal
        joins = np.flatnonzero(differs & ~new)
        if len(joins):
            # a differing row joins what differs; what is joined surely does where lengths of texts do, or did all agree in a first row that differs
            begins = np.flatnonzero(new)
            since = begins[np.cumsum(new)[joins] - 1]
            doubt = ~self._uneven(since, joins) & ~(differs[since] & ~self._uneven(since, since + 1))
            stops = np.r_[np.flatnonzero(equal | head), self.n_rows]
            for a in np.unique(since[doubt]).tolist():
                self._told(a, int(stops[np.searchsorted(stops, a, "right")]), differs, new)
        return new

    def _at(self, texts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where in the texts' bytes the cells of a row, or those after it, begin."""
        if not hasattr(self, "keys"):
            self.keys = self.text * (self.n_rows + 1) + self.row
        return self.bytes[np.searchsorted(self.keys, texts * (self.n_rows + 1) + rows)]

    def _uneven(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Do lengths of the texts of rows from a up to z differ?"""
        of = self.of_row[a]
        many = self.many[of]
        first = _before(many)
        texts = np.repeat(self.first_text[of] - first, many) + np.arange(int(many.sum()))
        lengths = self._at(texts, np.repeat(z, many)) - self._at(texts, np.repeat(a, many))
        return np.maximum.reduceat(lengths, first) != np.minimum.reduceat(lengths, first)

    def _told(self, a: int, z: int, differs: np.ndarray, new: np.ndarray) -> None:
        """Rows from a to z, of which the first begins an output row, by their texts."""
        c = self.of_row[a]
        texts = np.arange(self.first_text[c], self.first_text[c] + self.many[c])
        since = self._at(texts, np.full(len(texts), a))
        data = memoryview(self.data)
        for r in (a + 1 + np.flatnonzero(differs[a + 1 : z])).tolist():
            upto = self._at(texts, np.full(len(texts), r))
            if len(np.unique(upto - since)) > 1:
                new[r] = False
            elif len({bytes(data[x:y]) for x, y in zip(since.tolist(), upto.tolist(), strict=True)}) > 1:
                # of equal length and not equal: so they stay, whatever joins them
                new[r:z] = False
                return
            else:
                # an equal row within: what differs after it begins anew
                new[r], since = True, upto

    def _group(self, new: np.ndarray, merged: bool) -> None:
        """Output rows, and cells of theirs by text: begin and n are over the cells of all texts, in order."""
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        self.of = self.of_row[begins]
        own = np.bincount(self.of, minlength=len(self.many))
        self.first = _before(own)
        by_text = own[self.of_text]
        self.first_of_text = _before(by_text)
        self.by_text = by_text
        at = self.first_of_text[self.text] + group[self.row] - self.first[self.of_text[self.text]]
        self.n = np.bincount(at, minlength=int(by_text.sum()))
        begin = _before(self.n)
        self.texts = self._strings(self.bytes[np.r_[begin, len(self.text)]])
        self.gaps = self.n == 0
        self.gap_is_null = not merged
        if len(self.text):
            first, last = np.minimum(begin, len(self.text) - 1), np.maximum(begin + self.n - 1, 0)
            start = begins[np.arange(len(begin)) - np.repeat(self.first_of_text - self.first[self.of_text], by_text)]
            # an output row whose first row has a gap begins at 0
            self.starts = np.where(self.gaps | (self.row[first] != start), 0, self.start[first])
            self.ends = np.where(self.gaps, 0, self.end[last])
            self.incrs = np.where(self.gaps, 1, self.incr[last])
        else:
            self.starts = self.ends = self.incrs = begin
        # output rows of one equal row
        self.plain = self.alike[begins] & (np.diff(np.r_[begins, self.n_rows]) == 1) if merged else np.zeros(len(begins), bool)

    def change(self, texts: Callable[[pa.StringArray, np.ndarray], pa.StringArray | None]) -> None:
        """Other cell texts, if there are such, for those of the rows' texts one after the other; sizes: rows of each text."""
        found = texts(self.texts, self.by_text)
        if found is not None:
            self.texts, self.plain = found, np.zeros(len(self.plain), bool)

    def base_ends(self) -> np.ndarray:
        """Where each row ends in the base's text, in characters."""
        rows = np.arange(len(self.of)) - self.first[self.of] + self.first_of_text[self.first_text[self.of]]
        upto = np.cumsum(pc.utf8_length(self.texts.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.int64))
        return upto - np.r_[0, upto][self.first][self.of]

    def slices(self, members: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """From and to which row, cells of each row and which cells: rows by members (which text each witness has), some CELLS at once."""
        number = members.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = _sizes(members)
        first = _before(width)
        upto = np.cumsum(width[self.of])
        a = 0
        while a < len(self.of):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, "right")))
            of = self.of[a:z]
            sizes = width[of]
            c = np.repeat(of, sizes)
            w = np.arange(len(c)) - np.repeat(_before(sizes), sizes)
            yield a, z, sizes, self.first_of_text[self.first_text[c] + number[first[c] + w]] + np.repeat(np.arange(a, z) - self.first[of], sizes)
            a = z

    def cells(self, sizes: np.ndarray, at: np.ndarray) -> pa.ListArray:
        numbers = [pa.array(x[at], pa.int32()) for x in (self.starts, self.ends, self.incrs)]
        gaps = pa.array(self.gaps[at]) if self.gap_is_null else None
        return pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays([*numbers, self.texts.take(pa.array(at))], fields=CELL.fields, mask=gaps))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of which one column is `tokens`, cut into some of GROUP tokens or one row."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        upto = np.r_[0, np.cumsum(_sizes(lists.flatten()))][np.cumsum(_sizes(lists))]
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GROUP, "right")))
            yield batch.slice(a, z - a)
            a = z


def aligned(merged: bool, cleanup: str | None, names: list[str]):
    """collation_id, row_id, cells by witness, of batches of collation_id, of, tokens, words, norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            ids, of, tokens, words, norms = batch.columns
            rows = Rows(tokens, words, norms, merged, cleanup)
            for a, z, sizes, at in rows.slices(of):
                c = rows.of[a:z]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)), pa.array(np.arange(a, z) - rows.first[c], pa.int32()), rows.cells(sizes, at)], names)

    return run


def nested(merged: bool, cleanup: str | None, names: list[str]):
    """collation_id, segment, rows (lists of cells by witness), of batches of collation_id, segment, of, tokens, words, norms, chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            ids, segment, of, tokens, words, norms, chars = batch.columns
            rows = Rows(tokens, words, norms, merged, cleanup, chars)
            parts = [rows.cells(sizes, at) for _, _, sizes, at in rows.slices(of)]
            lists = pa.ListArray.from_arrays(_offsets(np.bincount(rows.of, minlength=len(ids))), pa.concat_arrays([pa.array([], pa.list_(CELL)), *parts]))
            yield pa.RecordBatch.from_arrays([ids, segment, lists], names)

    return run


def read(names: list[str], moved: Callable[[pa.StringArray, np.ndarray], pa.StringArray | None]):
    """collation_id, row_id, segs (cell texts by witness, as moved), alike, base_end, labels where texts are not alike, and others in a collation's first row.

    Of batches of collation_id, of, tokens, words, norms, labels and those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            ids, of, tokens, words, norms, labels, *others = batch.columns
            rows = Rows(tokens, words, norms)
            rows.change(moved)
            base_end = rows.base_ends()
            for a, z, sizes, at in rows.slices(of):
                c = rows.of[a:z]
                row = np.arange(a, z) - rows.first[c]
                segs = pa.ListArray.from_arrays(_offsets(sizes), rows.texts.take(pa.array(at)))
                alike = rows.plain[a:z]
                once = [x.take(pa.array(c, mask=row > 0)) for x in others]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)), pa.array(row, pa.int32()), segs, pa.array(alike), pa.array(base_end[a:z], pa.int32()), labels.take(pa.array(c, mask=alike)), *once], names)

    return run


def voted(names: list[str]):
    """collation_id, row_id, voted, differs, groups, as serialize.voted_rows() has them of cells weighed by count, of batches as of aligned()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            ids, of, tokens, words, norms = batch.columns
            rows = Rows(tokens, words, norms)
            for a, z, sizes, at in rows.slices(of):
                c = rows.of[a:z]
                # rows of one text have no more to tell
                apart = ~rows.plain[a:z]
                some = rows.texts.take(pa.array(at[np.repeat(apart, sizes)]))
                told = votes(counted(pa.ListArray.from_arrays(_offsets(sizes[apart]), pa.StructArray.from_arrays([some], ["text"]))), None)
                which = pa.array(np.cumsum(apart) - 1, mask=~apart)
                text = pc.if_else(pa.array(apart), told.field(0).take(which), rows.texts.take(pa.array(at[_before(sizes)])))
                differs = pc.fill_null(told.field(1).take(which), False)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)), pa.array(np.arange(a, z) - rows.first[c], pa.int32()), text, differs, told.field(2).take(which)], names)

    return run
