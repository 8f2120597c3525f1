"""Terms of whole Arrow batches, for tasks: what :func:`tessera.functions.text.terms` finds."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.functions.text import STOPWORDS

#: bytes of terms in lower case; every other byte, those of longer characters too, ends a term
_LOWER = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: the only longer characters whose lower case has a letter of a term in it (a test goes through all)
_FOLDED = {"İ": "i̇", "K": "k"}
#: texts that are worked on at a time, so that their arrays stay small
ROWS = 500
#: counted terms that a task holds at a time
HELD_TERMS = 1 << 19


def term_lists(text, remove_stopwords: bool = True):
    """(lists, terms, term) of an Arrow array of texts: the terms of each in order (a null has
    none), the different terms, and the number of each term as it stands."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(text, "")
    for found, lower in _FOLDED.items():
        text = pc.replace_substring(text, found, lower)
    data = text.buffers()[2]
    plain = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_LOWER))
    parts = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), text.buffers()[1], plain, offset=text.offset))
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    out = pa.array(["", *(STOPWORDS if remove_stopwords else ())])
    wanted = pc.invert(pc.is_in(coded.dictionary, value_set=out)).to_numpy(zero_copy_only=False)
    term = coded.indices.to_numpy(zero_copy_only=False)
    kept = wanted[term]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    before = np.concatenate([[0], np.cumsum(kept)])
    lists = pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(pa.array(kept)))
    return lists, coded.dictionary, term[kept]


class _Counted:
    """(term, df) of the batches of a task, added up in parts of at most about ``most``."""

    def __init__(self, most: int):
        self.most = most
        self.parts, self.size = [], 0

    def add(self, lists, terms, term) -> None:
        import numpy as np
        import pyarrow as pa

        ends = lists.offsets.to_numpy().tolist()
        place, last, once = np.arange(len(term)), np.empty(len(terms), np.int64), np.empty(len(term), bool)
        for low, high in zip(ends, ends[1:]):  # a term counts where it stands last in its text
            own = slice(low, high)
            last[term[own]] = place[own]
            once[own] = last[term[own]] == place[own]
        df = np.bincount(term[once], minlength=len(terms))
        held = pa.table({"term": terms, "df": df}).filter(pa.array(df > 0))
        self.parts.append(held)
        self.size += held.num_rows

    def take(self, all_of_it: bool) -> Iterator:
        """What is passed on now: nothing before the bound is reached."""
        import pyarrow as pa

        if not self.parts or not (all_of_it or self.size > self.most):
            return
        one = pa.concat_tables(self.parts).group_by("term", use_threads=False).aggregate([("df", "sum")]).select(["term", "df_sum"])
        self.parts, self.size = [one.rename_columns(["term", "df"])], one.num_rows
        if all_of_it or self.size > self.most // 2:
            yield from self.parts[0].combine_chunks().to_batches(max_chunksize=1 << 16)
            self.parts, self.size = [], 0


def packed_terms(remove_stopwords: bool, rows: int = ROWS, held: int = HELD_TERMS):
    """For batches (..., text), in one pass: rows (..., dl, words) of each text, the number of its
    terms, 1 at least, and the terms joined by blanks; and rows (term, df), in how many texts
    a term is, of which other tasks and later rows may have more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counted, own = _Counted(held), []
        for whole in batches:
            own = [f for f in whole.schema if f.name != "text"]
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lists, terms, term = term_lists(batch.column("text"), remove_stopwords)
                dl = pc.max_element_wise(pc.list_value_length(lists), pa.scalar(1, pa.int32()))
                none = {"term": pa.nulls(batch.num_rows, pa.string()), "df": pa.nulls(batch.num_rows, pa.int64())}
                yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in own} | {"dl": dl, "words": pc.binary_join(lists, " ")} | none)
                counted.add(lists, terms, term)
                yield from _term_rows(own, counted.take(False))
        yield from _term_rows(own, counted.take(True))

    return run


def _term_rows(own: list, counted: Iterator) -> Iterator:
    import pyarrow as pa

    for part in counted:
        none = {f.name: pa.nulls(part.num_rows, f.type) for f in own} | {"dl": pa.nulls(part.num_rows, pa.int32()), "words": pa.nulls(part.num_rows, pa.string())}
        yield pa.RecordBatch.from_pydict(none | {"term": part.column("term"), "df": part.column("df")})
