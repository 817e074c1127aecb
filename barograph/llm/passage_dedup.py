"""Substring dedup with repeated-phrase automata.

1. Anchors. Of the word n-grams inside each window the smallest hash is its anchor, so that equal windows have
   equal anchors. Anchors are counted over the corpus; only windows whose anchor recurs can recur.
2. Segments. The stretches of such windows, a part of the texts, go on.
3. Recurring windows are confirmed by counting whole ones, and where each is met first in the corpus is noted. Runs of
   first windows that go to one place are the passages.
4. Each window goes to one place, by its anchor: if the first windows of an anchor lie in one block of one segment,
   the passages of that block; else those of the anchor alone, split by the window's hash if there are many. So a
   window is sent once, however many passages have its anchor. Places are dealt to shards of bounded size. A shard's
   Aho-Corasick automaton (pyahocorasick) holds phrases of its passages, a letter for each word, so close together that
   every window holds one whole; the later windows of each segment stream through it. The windows around a phrase that is found are looked up
   among the passages' and compared, which gives every occurrence.
5. Words of occurrences of at least a window's length, but for the passage's own place, are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barograph.llm.common import MIX_A, cut, forget, gram_hashes, hash_filter, in_filter, mixed, shared_path, table, text_hashes, word_hashes, words_of

#: Words of an anchor.
ANCHOR = 8
#: Windows of a passage; longer ones are cut.
PASSAGE = 2000
#: First windows that the passages of one anchor may have at one place; more are split by the windows' hashes.
HOT = 4096
#: Slots of a hash in the anchor filter, and bits from one to the next.
SLOTS, SLOT_BITS = 4, 12
#: Characters of the segments that a shard matches at once, and measure of other parts of a batch; a longer text goes alone.
BATCH_CHARS = 1 << 18
#: Bits of a word's hash that are its letter in an automaton, 8 at most; a node's letters are looked through one by one.
LETTER_BITS = 7
#: Stands for a null id, which so is the smallest.
NO_ID = -(1 << 63)


def phrase_words(size: int) -> tuple[int, int]:
    """Words of a phrase, and how many words on the next one begins: each window of ``size`` words holds one whole."""
    words = (size + 1) // 2
    return words, size - words + 1


def anchor_filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """SLOTS Bloom filters of ``bits`` bits, each over other bits of the hashes."""
    return np.stack([hash_filter(anchors.select(F.shiftrightunsigned("hash", i * SLOT_BITS).alias("hash")), bits) for i in range(SLOTS)])


def may_recur(passed: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """For each hash (uint64) whether all filters may hold it; only what one lets through is looked up in the next."""
    may = np.arange(len(hashes))
    for i, part in enumerate(passed):
        may = may[in_filter(part, bits, hashes[may] >> np.uint64(i * SLOT_BITS))]
    out = np.zeros(len(hashes), bool)
    out[may] = True
    return out


def stretches(lengths: np.ndarray | list[int], most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows of about ``most`` characters, or one longer row."""
    part = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((i, j) for i, j in zip(edges[:-1], edges[1:], strict=True) if i < j)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of text, or one longer row."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b[text_col]), 0).to_numpy().astype(np.int64)
        yield from (b.slice(i, j - i) for i, j in stretches(lengths, most))


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words, made of grams of five."""
    part = min(5, size)
    grams, count = gram_hashes(words, part), len(words) - size + 1
    h = np.zeros(count, np.uint64)
    for j in [*range(0, size - part, part), size - part]:
        h = h * MIX_A + grams[j : j + count]
    return mixed(h)


def windows_in(texts: list[str], counts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of each text, one text after the other; ``counts``: windows of each, one at least."""
    out = np.empty(counts.sum(), np.uint64)
    stops = np.cumsum(counts)
    for i, j in stretches([len(text) for text in texts], 4 * BATCH_CHARS):
        n = counts[i:j]
        hashes = windows_of(text_hashes("\n".join(texts[i:j])), size)
        out[stops[i] - n[0] : stops[j - 1]] = hashes[np.arange(n.sum()) + np.repeat(np.arange(j - i) * (size - 1), n)]
    return out


def anchor_grams(words: np.ndarray, size: int) -> np.ndarray:
    return gram_hashes(words, min(ANCHOR, size))


def anchors_of(grams: np.ndarray, size: int) -> np.ndarray:
    """Anchor of each window: the least of its gram hashes, by minima of doubling runs."""
    least, have, want = grams, 1, size - min(ANCHOR, size) + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def several_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids that have several texts: as a rule none."""
    th = F.xxhash64(text_col)
    return cut(docs.groupBy(_id(id_col).alias("several")).agg(F.min(th).alias("low"), F.max(th).alias("high")).where("low < high").select("several"), "ids-of-several")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, several: DataFrame, doc: str, th: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with columns that name a text: its id and, for ids of several texts, the text's hash (0 else)."""
    named = docs.withColumn(doc, _id(id_col))
    if several.isEmpty():
        return named.withColumn(th, F.lit(0).cast("long"))
    return named.join(several, F.col(doc) == F.col("several"), "left").withColumn(th, F.when(F.col("several").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text_col))).drop("several")


def recurring_anchors(texts: DataFrame, size: int) -> DataFrame:
    """Hashes of the anchors that the corpus has more than once; equal ones of a batch are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b["text"].to_pylist():
                w = text_hashes(text)
                if len(w) >= size:
                    grams = anchor_grams(w, size)
                    least = anchors_of(grams, size)
                    found.append(np.unique(least[runs_of(least)]))
                    grams.sort()
                    again = grams[1:][grams[1:] == grams[:-1]]
                    if len(again):  # anchors that the text has at several places count twice
                        found.append(np.intersect1d(found[-1], again))
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["hash", "many"])

    rows = texts.select("text").mapInArrow(run, "hash long, many boolean")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("hash")


SEGMENT = "doc long, th long, start int, text string, anchors array<long>, firsts array<int>, stops array<int>"


def candidate_segments(texts: DataFrame, size: int, passed: np.ndarray, bits: int) -> DataFrame:
    """SEGMENT rows: the longest stretches of windows whose anchors may recur.

    Windows ``firsts[i]`` to ``stops[i]`` of a stretch, counted from its start, have the anchor ``anchors[i]``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for b in slices(batches, "text", 8 * BATCH_CHARS):
            rows, starts, parts, anchors, firsts, stops = [], [], [], [], [], []
            for k, text in enumerate(b["text"].to_pylist()):
                hashes = text_hashes(text)
                if len(hashes) < size:
                    continue
                least = anchors_of(anchor_grams(hashes, size), size)
                runs = runs_of(least)
                may = np.repeat(may_recur(passed, bits, least[runs]), np.diff(np.append(runs, len(least))))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], may, [False]))))
                words = words_of(text) if len(edge) else []
                for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    rows.append(k)
                    starts.append(first)
                    parts.append(b" ".join(words[first : stop + size - 1]).decode("utf-8", "surrogatepass"))
                    own = runs_of(least[first:stop])
                    anchors.append(least[first:stop][own].view(np.int64))
                    firsts.append(own.astype(np.int32))
                    stops.append(np.append(own[1:], stop - first).astype(np.int32))
            at = pa.array(rows, pa.int64())
            columns = [b["doc"].take(at), b["th"].take(at), pa.array(starts, pa.int32()), pa.array(parts, pa.string()), pa.array(anchors, longs), pa.array(firsts, ints), pa.array(stops, ints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "th", "start", "text", "anchors", "firsts", "stops"])

    return texts.mapInArrow(run, SEGMENT)


def first_of_equal(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of all equal hashes, in order, and whether there are more or one of them says so."""
    order = np.argsort(hashes, kind="stable")
    begins = runs_of(hashes[order])
    recurs = (np.diff(np.append(begins, len(hashes))) > 1) | np.logical_or.reduceat(many[order], begins)
    first = order[begins]
    again = np.argsort(first)
    return first[again], recurs[again]


FIRSTS = "anchor long, place long, split int, doc long, th long, start int, at array<int>"


def first_places(segments: DataFrame, size: int) -> DataFrame:
    """FIRSTS rows: doc, th, start of a segment and ``at``, windows in it: those of one anchor that recur, where each is met first of all equal ones.

    The first row of each anchor says where its windows go (``place``, null in others), and over how many places
    they are split by their hashes: 0 if one block of one segment has all first ones, which so is the place.
    Windows go in runs of one anchor, since equal windows have equal anchors. A batch passes on the first place of each
    of its windows only, so that a window that a third of the documents hold reaches the task that orders its
    places once a batch. That task carries from batch to batch what windows of one anchor it has met.
    """
    runs = "anchor long, doc long, th long, start int, at array<int>, hash array<long>, many array<boolean>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 32 * BATCH_CHARS):
            b = b.sort_by([("doc", "ascending"), ("th", "ascending"), ("start", "ascending")])
            n = b["stops"].flatten().to_numpy()[np.cumsum(pc.list_value_length(b["stops"]).to_numpy()) - 1].astype(np.int64)
            h = windows_in(b["text"].to_pylist(), n, size)
            at = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            of_row = np.repeat(np.arange(len(b)), pc.list_value_length(b["anchors"]).to_numpy())
            of_run = np.repeat(np.arange(len(of_row)), b["stops"].flatten().to_numpy() - b["firsts"].flatten().to_numpy())
            first, many = first_of_equal(h, np.zeros(len(h), bool))
            begins = runs_of(of_run[first])
            run, lists = of_run[first][begins], pa.array(np.append(begins, len(first)).astype(np.int32))
            rows = pa.array(of_row[run])
            listed = lambda x: pa.ListArray.from_arrays(lists, pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b["anchors"].flatten().take(pa.array(run)), *(b[c].take(rows) for c in ("doc", "th", "start")), listed(at[first].astype(np.int32)), listed(h[first].view(np.int64)), listed(many)], ["anchor", "doc", "th", "start", "at", "hash", "many"])

    def overall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the last anchor, the windows met so far: rows anchor, doc, th, start, hash, at, many

        def placed(rows: pa.Table) -> pa.RecordBatch:
            anchor, doc, th, start, at = (rows[c].to_numpy() for c in ("anchor", "doc", "th", "start", "at"))
            new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(th) != 0) | (np.diff(start) != 0))
            begins, own = np.concatenate(([0], new + 1)), runs_of(anchor)
            block = mixed(doc.view(np.uint64) * MIX_A + th.view(np.uint64))
            block = mixed(block * MIX_A + (start.astype(np.uint64) << np.uint64(32)) + (at // PASSAGE).astype(np.uint64)).view(np.int64)
            low = np.minimum.reduceat(block, own)
            alone = low == np.maximum.reduceat(block, own)
            leads = np.isin(begins, own)
            place, split = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int32)
            place[leads] = np.where(alone, low, anchor[own])
            split[leads] = np.where(alone, 0, -(-np.diff(np.append(own, len(anchor))) // HOT))
            lists = pa.array(np.append(begins, len(doc)).astype(np.int32))
            columns = [pa.array(anchor[begins]), pa.array(place, mask=~leads), pa.array(split), pa.array(doc[begins]), pa.array(th[begins]), pa.array(start[begins]), pa.ListArray.from_arrays(lists, pa.array(at))]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "place", "split", "doc", "th", "start", "at"])

        for b in batches:
            if not len(b):
                continue
            of_row = pa.array(np.repeat(np.arange(len(b)), pc.list_value_length(b["hash"]).to_numpy()))
            rows = pa.table([*(b[c].take(of_row) for c in ("anchor", "doc", "th", "start")), *(b[c].flatten() for c in ("hash", "at", "many"))], ["anchor", "doc", "th", "start", "hash", "at", "many"])
            rows = pa.concat_tables([last, rows]).combine_chunks() if last else rows
            first, recurs = first_of_equal(rows["hash"].to_numpy(), rows["many"].to_numpy())
            rows = rows.take(pa.array(first)).drop(["many"]).append_column("many", pa.array(recurs))
            open_ = rows["anchor"].to_numpy() == b["anchor"][len(b) - 1].as_py()  # may go on in the next batch
            last = rows.filter(pa.array(open_))
            if (~open_ & recurs).any():
                yield placed(rows.filter(pa.array(~open_ & recurs)))
        if last and pc.any(last["many"]).as_py():
            yield placed(last.filter(last["many"]))

    made = segments.select("doc", "th", "start", "text", "anchors", "firsts", "stops").mapInArrow(local, runs)
    return made.repartition("anchor").sortWithinPartitions("anchor", "doc", "th", "start", "at").mapInArrow(overall, FIRSTS)


PIECES = "passage boolean, place long, doc long, th long, start int, text string"


def pieces_of(segments: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """PIECES rows: each segment's windows by the place that they go to; passages (first windows), and what is matched with them.

    A window has one place, so there are no more rows than windows. Ids alone meet on anchors, a row for each run.
    """
    ids = ["doc", "th", "start"]
    routes = firsts.where("place is not null").select("anchor", "place", "split")
    each = segments.select(*ids, F.explode(F.arrays_zip("anchors", "firsts", "stops")).alias("run")).select(*ids, F.col("run.anchors").alias("anchor"), F.col("run.firsts").alias("first"), F.col("run.stops").alias("stop"))
    runs = each.join(routes, "anchor").groupBy(*ids).agg(F.collect_list(F.struct("first", "stop", "place", "split")).alias("runs"))
    held = firsts.groupBy(*ids).agg(F.flatten(F.collect_list("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(pieces, slices(batches, "text", 8 * BATCH_CHARS))

    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b["text"].cast(pa.binary()).to_pylist()
        lines = b" ".join(raw) + b" "
        begins = np.concatenate(([0], np.flatnonzero(np.frombuffer(lines, np.uint8) == 32) + 1))  # of words
        words = np.array([text.count(b" ") + 1 for text in raw])
        base = np.cumsum(words) - words
        first, stop, place, split = (b["runs"].flatten().field(c).to_numpy() for c in ("first", "stop", "place", "split"))
        n = (stop - first).astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(b)), pc.list_value_length(b["runs"]).to_numpy()), n)
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        place, split = np.repeat(place, n), np.repeat(split, n)
        if (many := split > 1).any():
            rows = np.unique(row[many])
            counts = words[rows] - size + 1
            hashes = windows_in([raw[k].decode("utf-8", "surrogatepass") for k in rows], counts, size)
            offset = np.zeros(len(b), np.int64)
            offset[rows] = np.cumsum(counts) - counts
            place[many] += (hashes[offset[row[many]] + at[many]] % split[many].astype(np.uint64)).astype(np.int64)
        at_row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(b["at"]), 0).to_numpy())
        known = np.isin(row << 32 | at, at_row << 32 | b["at"].flatten().to_numpy())
        order = np.lexsort((at, place, row, known))
        row, at, place, known = row[order], at[order], place[order], known[order]
        # passages have no other windows in them; what is matched may, if it has a word in common with what is before
        new = np.flatnonzero((np.diff(known) != 0) | (np.diff(row) != 0) | (np.diff(place) != 0) | (np.diff(at) > np.where(known[1:], 1, size - 1))) + 1
        low, high = np.concatenate(([0], new)), np.append(new, len(row)) - 1
        mine = row[low]
        starts, stops = begins[base[mine] + at[low]], begins[base[mine] + at[high] + size] - 1
        texts = pa.array([lines[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()).cast(pa.string())
        of, begin = pa.array(mine), b["start"].to_numpy()[mine] + at[low]
        return pa.RecordBatch.from_arrays([pa.array(known[low]), pa.array(place[low]), b["doc"].take(of), b["th"].take(of), pa.array(begin.astype(np.int32)), texts], ["passage", "place", *ids, "text"])

    return segments.select(*ids, "text").join(runs.join(held, ids, "left"), ids).mapInArrow(run, PIECES)


class Shard:
    """Automaton over phrases of some passages, and where each of their windows is.

    The automaton has a letter for each word, LETTER_BITS of its hash, so that it has no more nodes than the passages have
    words. It misses no phrase; what it finds wrongly is dropped when windows are looked up and compared.
    """

    def __init__(self, passages: pa.Table, size: int):
        self.size, (self.phrase, step) = size, phrase_words(size)
        self.doc, self.th, self.start = (passages[c].to_numpy() for c in ("doc", "th", "start"))
        self.lines, self.begins, self.stops = lines_of(passages["text"].to_pylist())
        words, firsts = word_hashes(self.lines), np.concatenate(([0], self.stops[:-1]))
        letters = letters_of(words)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for first, stop in zip(firsts.tolist(), self.stops.tolist(), strict=True):
            for at in range(first, stop - self.phrase + 1, step):
                self.automaton.add_word(letters[at : at + self.phrase])
        self.automaton.make_automaton()
        n = self.stops - firsts - size + 1  # windows of each passage, one at least
        self.at = np.arange(n.sum()) + np.repeat(firsts - (np.cumsum(n) - n), n)  # the word that a window begins with
        self.hash = windows_of(words, size)[self.at]
        order = np.argsort(self.hash)
        self.hash, self.at = self.hash[order], self.at[order]

    def occurrences(self, doc: np.ndarray, th: np.ndarray, start: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """Number of a segment, start and number of words of stretches of it that passages have elsewhere.

        The automaton finds phrases in all segments at once; the windows that hold one whole are looked up among
        those of the passages, and runs of them that go on in one passage are compared word by word. A segment has a window's
        length at least.
        """
        lines, begins, stops = lines_of(texts)
        words, firsts = word_hashes(lines), np.concatenate(([0], stops[:-1]))
        at = np.fromiter((end for end, _ in self.automaton.iter(letters_of(words))), np.int64) - (self.phrase - 1)  # words that a phrase begins with
        row = np.searchsorted(stops, at, "right")
        inside = at + self.phrase <= stops[row]  # not the end of a segment and the begin of the next
        at, row = at[inside], row[inside]
        if not len(at):
            return
        hashes = windows_of(words, self.size)
        low, high = np.maximum(at - (self.size - self.phrase), firsts[row]), np.minimum(at, stops[row] - self.size)  # windows of the same segment
        near = np.bincount(low, minlength=len(hashes) + 1) - np.bincount(high + 1, minlength=len(hashes) + 1)
        mine = np.flatnonzero(near.cumsum()[:-1])
        place = np.minimum(np.searchsorted(self.hash, hashes[mine]), len(self.hash) - 1)
        held = self.hash[place] == hashes[mine]
        known, mine = self.at[place[held]], mine[held]
        owner, row = np.searchsorted(self.stops, known, "right"), np.searchsorted(stops, mine, "right")
        offset = known - np.concatenate(([0], self.stops[:-1]))[owner]
        other = (self.doc[owner] != doc[row]) | (self.th[owner] != th[row]) | (self.start[owner] + offset != start[row] + mine - firsts[row])  # not the passage itself
        owner, known, mine, row = owner[other], known[other], mine[other], row[other]
        if not len(mine):
            return
        cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(known) != 1) | (np.diff(mine) != 1) | (np.diff(row) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mine)], strict=True):
            a, k, n, r = int(mine[i]), int(known[i]), j - i + self.size - 1, int(row[i])
            alike = lambda x, n: lines[begins[a + x] : begins[a + x + n]] == self.lines[self.begins[k + x] : self.begins[k + x + n]]  # noqa: B023, E731
            begin = int(start[r] - firsts[r]) + a
            if alike(0, n):
                yield r, begin, n
            else:  # windows of equal hashes that differ
                yield from ((r, begin + x, self.size) for x in range(j - i) if alike(x, self.size))


def lines_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts of words with one blank between as one, each word with a blank behind; where words begin in it, and the end; words up to the end of each text."""
    lines = " ".join([*texts, ""]).encode("utf-8", "surrogatepass")
    begins = np.concatenate(([0], np.flatnonzero(np.frombuffer(lines, np.uint8) == 32) + 1))
    return lines, begins, np.cumsum([text.count(" ") + 1 for text in texts])


def letters_of(words: np.ndarray) -> str:
    """A letter for each word hash."""
    return (words >> np.uint64(64 - LETTER_BITS)).astype(np.uint8).tobytes().decode("latin-1")


def located(parts: DataFrame, folder: str, size: int) -> DataFrame:
    """doc, th, start, n of every occurrence of a passage but its own place; passages lie in ``folder`` by shard.

    ``parts`` (of pieces_of()) are dealt by ranges of shard and place, so that several tasks share a shard that many
    segments go to, and a task makes one automaton after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        now, shard = None, None
        for b in batches:
            out, text = [], b["text"]
            kind, doc, th, start = (b[c].to_numpy() for c in ("shard", "doc", "th", "start"))
            part = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64)) // BATCH_CHARS
            edges = np.flatnonzero((np.diff(kind) != 0) | (np.diff(part) != 0)) + 1 if len(text) else ()
            for i, j in zip([0, *edges], [*edges, len(text)], strict=True):
                if i == j:
                    continue
                if kind[i] != now:
                    now, shard = kind[i], None  # the last one is freed first
                    shard = Shard(ds.dataset(f"{top}/shard={now}", filesystem=store, format="parquet").to_table(["doc", "th", "start", "text"]), size)
                out += [(int(doc[i + r]), int(th[i + r]), s, n) for r, s, n in shard.occurrences(doc[i:j], th[i:j], start[i:j], text.slice(i, j - i).to_pylist())]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "th", "start", "n"])

    dealt = parts.repartitionByRange("shard", "doc", "th", "start").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "doc long, th long, start int, n int")


def dedup_passages(docs: DataFrame, size: int = 20, filter_bits: int = 1 << 24, shard_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated passages, and n_words, n_removed.

    A word goes if a window of ``size`` words covers it whose word sequence also starts earlier: in a
    document with a smaller id, or earlier in the same one. Windows are judged on the input. Words are runs of other
    characters than \\x20 and \\x09-\\x0D; those kept are joined by one blank. Null texts have no words and become empty.
    A null id counts as the smallest. Rows that repeat id and text are one document; texts that share an id are
    documents in the order of a hash of theirs. Ids must be whole numbers. Input columns named n_words or n_removed
    are replaced; all others pass through.

    ``filter_bits``: least size of the anchor filter, the only thing that is sent to all tasks; it grows with the number
    of recurring anchors, 8 to 16 bits for each. ``shard_chars``: bound of the characters in one shard's phrases.
    """
    spark = docs.sparkSession
    several = several_texts(docs, id_col, text_col)
    texts = keyed(docs.select(id_col, F.col(text_col).alias("text")), several, "doc", "th", id_col, "text").select("doc", "th", "text")
    anchors = cut(recurring_anchors(texts, size), "anchors")
    bits = max(filter_bits // SLOTS, 1 << (8 // SLOTS * anchors.count()).bit_length())
    segments = cut(candidate_segments(texts, size, anchor_filter(anchors, bits), bits), "segments")
    forget(anchors)
    firsts = cut(first_places(segments, size), "firsts")
    pieces = cut(pieces_of(segments, firsts, size), "pieces")
    forget(segments)
    forget(firsts)
    chars = pieces.where("passage").agg(F.sum(F.length("text"))).first()[0] or 0
    words, step = phrase_words(size)
    shards = max(1, -(-chars * words // (step * shard_chars)))
    folder = shared_path(spark, "shards")
    pieces = pieces.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    columns = ["shard", "doc", "th", "start", "text"]
    pieces.where("passage").select(columns).repartition("shard").write.partitionBy("shard").parquet(folder)
    spots = cut(located(pieces.where("not passage").select(columns), folder, size).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("_pd_spots")), "spots")
    forget(pieces)
    if chars:
        forget(spark.read.parquet(folder))

    kept = docs.drop("n_words", "n_removed")
    named = keyed(kept, several, "_pd_doc", "_pd_th", id_col, text_col)
    joined = named.join(spots.withColumnsRenamed({"doc": "_pd_doc", "th": "_pd_th"}), ["_pd_doc", "_pd_th"], "left").select(*kept.columns, "_pd_spots")
    schema = StructType([*kept.schema.fields]).add("n_words", "long").add("n_removed", "long")
    held, names = kept.columns, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 8 * BATCH_CHARS):
            text_out, n_words, n_removed = [], [], []
            for text, each in zip(b[text_col].to_pylist(), b["_pd_spots"].to_pylist(), strict=True):
                words = words_of(text)
                keep = np.ones(len(words), bool)
                for x in each or ():
                    keep[x["start"] : x["start"] + x["n"]] = False
                stay = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                text_out.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
            columns = [pa.array(text_out, pa.string()) if c == text_col else b[c] for c in held]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names)

    return joined.mapInArrow(run, schema)


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, size=20).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
