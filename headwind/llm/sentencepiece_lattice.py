"""SentencePiece encoding and decoding with exact N-best segmentation.

The pieces of a model span a lattice over a text; a segmentation is a path through it and scores the sum of its pieces.
A forward Viterbi pass gives the best score of every prefix. A backward A-star search from the end uses these scores as
its heuristic. They are exact, so an edge costs only what it loses against the best way to its end, paths leave the agenda
in order of their total loss, each entry stands for a path of just its loss, and the agenda needs no more entries than paths
are still wanted.

The scores are those of the model file. In a BPE model they are ranks of merges, so their best sum is not what the merges
give: of 300 texts of the test tables none had the same ids as the library's own encoding. A unigram model has log
probabilities there, and its best segmentation is the library's.

No piece holds certain pairs of neighbouring characters, so every path has a boundary there. Texts fall apart at these
points into words, chunks (letters, and what is between letters) and units that are searched on their own and remembered
by each worker (bounded); the N best of a text follow exactly from the N best of its parts. Characters without a piece are spelled in byte pieces, at a score below all
others.

Defined cases: a null or empty text has no pieces, score 0 and one (empty) segmentation; a text has fewer than N
segmentations if its lattice has fewer paths; segmentations of equal score are taken in a fixed order (longer last pieces
first); repeated rows each give a row; an empty table gives an empty result; extra columns are ignored. Decoding the
pieces gives the text back, but for the mark U+2581, which the format cannot tell from a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm.tables import slices, texts

SCHEMA = "doc_id long, n_pieces long, best_score double, nbest_scores array<double>, ids_crc32 long, round_trip boolean"
NBEST = 4
SPACE = "▁"
UNKNOWN = 10.0  # a character without a piece scores this much below the lowest piece
CACHED = 500_000
LONG = 48
SLICE = 128

_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LETTER = re.compile(r"[^\W\d_]")
_CHUNKS = re.compile(r" *+[^\W\d_]++| *+(?:[^\w ]++|[\d_]++)++| ++")

Path = tuple[float, tuple[int, ...]]  # score, ids


class Lattice:
    """The pieces of a model, ready for search."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.texts, self.bytes = {}, [], [], {}
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.scores.append(score)
            self.texts.append(piece)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        self.lowest = min((s for p, i in self.ids.items() if (s := self.scores[i]) > -1e8), default=0.0) - UNKNOWN
        self.unknown_id = sp.unk_id()
        # the pieces as a tree of characters: what follows, score and ids, without ids where no piece ends
        self.tree: dict[str, tuple] = {}
        for piece, i in self.ids.items():
            kids = self.tree
            for char in piece[:-1]:
                kids = kids.setdefault(char, ({}, 0.0, ()))[0]
            kids[piece[-1]] = (kids.get(piece[-1], ({},))[0], self.scores[i], (i,))
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # letters that some piece joins with another character; texts that hold one are not cut between letters and the rest
        mixed = {pair for pair in self.joined if SPACE not in pair and bool(_LETTER.match(pair[0])) != bool(_LETTER.match(pair[1]))}
        self.odd = {char for pair in mixed for char in pair if _LETTER.match(char)} | {SPACE}
        self.raw = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.units: dict[str, list[Path]] = {}

    def spelled(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character, or the unknown piece where the model has none."""
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown_id,)

    def forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """The best score of every prefix, and the edges by their end: start, score, ids."""
        size = len(unit)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [-np.inf] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            here, kids, j = best[i], self.tree, i
            for char in unit[i:]:
                hit = kids.get(char)
                if hit is None:
                    break
                kids, score, piece = hit
                j += 1
                if piece:
                    into[j].append((i, score, piece))
                    if here + score > best[j]:
                        best[j] = here + score
            if unit[i] not in self.ids:
                into[i + 1].append((i, self.lowest, self.spelled(unit[i])))
                if here + self.lowest > best[i + 1]:
                    best[i + 1] = here + self.lowest
        return best, into

    def first(self, unit: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best segmentation, and what the second best loses (infinity: there is none).

        The second best leaves the best way at one edge, so it loses what the runner-up into one place of that way loses.
        """
        size, tree, ids = len(unit), self.tree, self.ids
        best, runner = [-np.inf] * (size + 1), [-np.inf] * (size + 1)
        start, pieces = [0] * (size + 1), [()] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            here, kids, j = best[i], tree, i
            for char in unit[i:]:
                hit = kids.get(char)
                if hit is None:
                    break
                kids, score, piece = hit
                j += 1
                if piece:
                    score += here
                    if score > best[j]:
                        runner[j], best[j], start[j], pieces[j] = best[j], score, i, piece
                    elif score > runner[j]:
                        runner[j] = score
            if unit[i] not in ids:
                score, j = here + self.lowest, i + 1
                if score > best[j]:
                    runner[j], best[j], start[j], pieces[j] = best[j], score, i, self.spelled(unit[i])
                elif score > runner[j]:
                    runner[j] = score
        at, way, second = size, [], np.inf
        while at:
            second = min(second, best[at] - runner[at])
            way.append(pieces[at])
            at = start[at]
        return best[size], tuple([i for own in reversed(way) for i in own]), second

    def search(self, unit: str, n: int) -> list[Path]:
        """The ``n`` best segmentations of a unit, best first."""
        size = len(unit)
        best, into = self.forward(unit)
        # What an edge loses against the best way to its end; the forward scores are exact, so one edge into each place loses nothing.
        lost: list[list[tuple[float, int, tuple[int, ...]]] | None] = [None] * (size + 1)
        found: list[Path] = []
        agenda: list[tuple] = [(0.0, 0, size, None)]
        order = 0
        while agenda:
            total, _, at, path = agenda.pop(0)
            room = n - len(found) - 1  # every entry leads to a path of just its loss, so no more entries are ever needed
            while at:
                edges = lost[at]
                if edges is None:
                    top = best[at]
                    edges = lost[at] = sorted([(top - best[i] - score, i, piece) for i, score, piece in into[at]])
                for loss, i, piece in edges[1:]:
                    whole = total + loss
                    if len(agenda) >= room:
                        if not agenda or whole >= agenda[-1][0]:
                            break
                        agenda.pop()
                    order += 1
                    insort(agenda, (whole, order, i, (piece, path)))
                _, at, piece = edges[0]
                path = (piece, path)
            flat: list[int] = []
            while path is not None:
                flat += path[0]
                path = path[1]
            found.append((best[size] - total, tuple(flat)))
            if len(found) == n:
                break
        return found

    def nbest_unit(self, unit: str, n: int) -> list[Path]:
        key = unit if n == NBEST else f"{n}\0{unit}"
        known = self.units.get(key)
        if known is None:
            known = self.search(unit, n)
            if len(unit) <= LONG:
                if len(self.units) >= CACHED:
                    self.units.clear()
                self.units[key] = known
        return known

    def units_of(self, word: str) -> list[str]:
        """The word cut where no piece reaches over."""
        joined = self.joined
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def nbest_word(self, word: str, n: int) -> list[Path]:
        """The ``n`` best of a word: its units' lists merged."""
        return merged([self.nbest_unit(u, n) for u in self.units_of(word)], n)

    def words(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before each run of marks; no piece reaches over such a cut."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:  # runs of marks, with the one that leads the text
            return _RUNS.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")

    def chunks(self, text: str) -> list[str]:
        """The text cut before blanks and between letters and other characters, with its blanks as they are.

        Far fewer chunks than words are different, as marks stand after any word.
        """
        if not text:
            return []
        return self.words(text) if any(char in text for char in self.odd) else _CHUNKS.findall(" " + text)

    def nbest(self, text: str, n: int = NBEST) -> list[Path]:
        """The ``n`` best segmentations of a text."""
        return merged([self.nbest_word(w, n) for w in self.words(text)], n)

    def decode(self, ids: Iterable[int]) -> str:
        return self.spelling(ids).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")

    def spelling(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def least_sums(lists: list[list[float]], n: int) -> list[list[tuple[int, int]]]:
    """The ``n`` choices of one entry from each list with the least sum of losses against the first entries, as changes.

    A choice among the best leaves the first entry only in lists whose second entry loses least, so at most n - 1 count.
    """
    open_ = heapq.nsmallest(n - 1, ((own[1], k) for k, own in enumerate(lists) if len(own) > 1))
    best: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
    for _, k in open_:
        grown = [(loss + own, [*way, (k, i)] if i else way) for loss, way in best for i, own in enumerate(lists[k])]
        grown.sort(key=lambda x: x[0])
        best = grown[:n]
    return [way for _, way in best]


def merged(parts: list[list[Path]], n: int) -> list[Path]:
    open_ = [k for k, p in enumerate(parts) if len(p) > 1]
    if len(open_) < 2:  # one part at most has a choice: its paths between what stands around it
        k = open_[0] if open_ else 0
        before, after = [p[0] for p in parts[:k]], [p[0] for p in parts[k + 1 :]]
        rest = sum([s for s, _ in before]) + sum([s for s, _ in after])
        left, right = tuple([i for _, ids in before for i in ids]), tuple([i for _, ids in after for i in ids])
        return [(s + rest, left + ids + right) for s, ids in (parts[k] if parts else [(0.0, ())])]
    ways = least_sums([[p[0][0] - q[0] for q in p] for p in parts], n)
    out = []
    for way in ways:
        chosen = dict(way)
        paths = [p[chosen.get(k, 0)] for k, p in enumerate(parts)]
        out.append((sum(p[0] for p in paths), tuple(i for p in paths for i in p[1])))
    return out


_lattices: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


class _Words:
    """Per chunk: the best score, the loss of the second best, number of pieces, ids as bytes and whether they spell it.

    A text's ``n`` best leave their best way only in the ``n - 1`` chunks whose second best loses least, so only those
    are searched for more than two. What was met lately is kept in two tables; a full one takes the place of the older.
    """

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.n = lattice, n
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.deep: dict[str, tuple[float, ...]] = {}

    def look(self, words: list[str]) -> list[tuple]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHED:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            for k, entry in enumerate(found):
                if entry is None:
                    word = words[k]
                    entry = known.get(word) or older.get(word) or self.entry(word.replace(" ", SPACE))
                    if len(word) <= LONG:
                        known[word] = entry
                    found[k] = entry
        return found

    def entry(self, word: str) -> tuple:
        units = self.lattice.units_of(word)
        if len(units) == 1:
            score, ids, second = self.lattice.first(word)
        else:
            parts = list(map(self.lattice.first, units))
            score, second = sum([p[0] for p in parts]), min([p[2] for p in parts])
            ids = [i for p in parts for i in p[1]]
        return score, second, len(ids), array("I", ids).tobytes(), self.lattice.spelling(ids) == word.encode("utf-8", "surrogatepass")

    def losses(self, word: str) -> tuple[float, ...]:
        """What the second to ``n``-th best of a word lose."""
        found = self.deep.get(word)
        if found is None:
            paths = self.lattice.nbest_word(word.replace(" ", SPACE), self.n)
            found = tuple(paths[0][0] - s for s, _ in paths[1:])
            if len(word) <= LONG:
                if len(self.deep) > CACHED:
                    self.deep.clear()
                self.deep[word] = found
        return found


_words: dict[tuple, _Words] = {}


def id_lists(sizes: list[int], raw: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *sizes]).astype(np.int32)  # a slice holds far fewer ids than an offset can number
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """For every row: pieces and score of the best segmentation, the scores of the ``n`` best, a checksum, a round trip.

    ``with_ids`` adds the ids of the best segmentation, some two bytes for each byte of text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_path)
        own = _words.setdefault((model_path, n), _Words(lattice, n))
        for batch in slices(batches, SLICE):
            pieces, best, scores, ids, crc, trip = [], [], [], [], [], []
            for text in texts(batch.column(1)):
                words = lattice.chunks(text)
                values, seconds, counts, parts, spelled = zip(*own.look(words)) if words else ((),) * 5
                top = sum(values)
                sums, k, before = [0.0], -1, None
                for second in heapq.nsmallest(n - 1, seconds):
                    if second < np.inf:
                        k = seconds.index(second, k + 1 if second == before else 0)
                        before = second
                        sums = sorted(s + loss for s in sums for loss in (0.0, *own.losses(words[k])))[:n]
                pieces.append(sum(counts))
                best.append(float(top))
                scores.append([float(top - s) for s in sums])
                raw = b"".join(parts)
                if with_ids:
                    ids.append(raw)
                crc.append(zlib.crc32(raw))
                trip.append(all(spelled))
            more = {"ids": id_lists(pieces, ids)} if with_ids else {}
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "n_pieces": pa.array(pieces, pa.int64()), "best_score": pa.array(best, pa.float64()),
                    "nbest_scores": pa.array(scores, pa.list_(pa.float64())), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(trip, pa.bool_()), **more,
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST) -> DataFrame:
    """``doc_id, rank, score, ids``: the segmentations themselves, for texts whose ids are wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_path)
        for batch in slices(batches, SLICE):
            out: dict[str, list] = {"doc_id": [], "rank": [], "score": [], "ids": []}
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for rank, (score, ids) in enumerate(lattice.nbest(text, n), 1):
                    for name, value in zip(out, (key, rank, float(score), list(ids))):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    schema = "doc_id long, rank int, score double, ids array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``rows`` with the text of the ids; null ids decode to null."""
    from pyspark.sql.types import StringType, StructField, StructType

    at = rows.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_path)
        for batch in slices(batches, SLICE):
            found = [None if ids is None else lattice.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))
