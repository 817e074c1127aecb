"""Secret scans by grammar inference.

Patterns find labelled credentials. From a bounded sample of each kind's, and of ordinary tokens, a probabilistic automaton is
inferred: a prefix tree of character classes whose states are merged where their statistics agree. Then every token of
every text is scored: one that no pattern has found is a secret if a kind's automaton makes it likelier than the
ordinary tokens' does, and as likely as that kind's own credentials are.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import cut, table

#: Base patterns by kind, in the order that ties of their spans have (fixed values).
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
#: The group that is the secret itself, and its least length (fixed values; for access and hex all of it).
SECRET, LEAST = {"assign": 2, "access": 0, "hex": 0}, {"assign": 12, "access": 18, "hex": 16}
#: Words of which a text with an assign match holds one, in lower case (fixed values).
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that are scored: runs of the characters of an assigned value, no shorter than it may be.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ORDINARY = "ordinary"
#: How much likelier a secret must be than an ordinary token: a million times.
MARGIN = math.log(1e6)
#: Classes of characters, of which automata read strings; others are classes of their own.
CLASSES = {c: name for name, chars in (("d", "0123456789"), ("x", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("X", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars}
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the matches of each kind, leftmost and without overlap; those too short are dropped.

    Places are code points, of the whole match. They are by start, then by kind as listed.
    """
    found = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [("assign", m) for m in PATTERNS["assign"].finditer(text)]
    if "AKIA" in text:
        found += [("access", m) for m in PATTERNS["access"].finditer(text)]
    found += [("hex", m) for m in LONG_HEX.finditer(text)]  # a run is taken whole, so that shorter ones can be passed over at once
    spans = [(kind, m.start(), m.end(), m[SECRET[kind]]) for kind, m in found if len(m[SECRET[kind]]) >= LEAST[kind]]
    order = list(PATTERNS)
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def other_tokens(text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens that no span overlaps."""
    out, k, reach = [], 0, -1
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            reach, k = max(reach, spans[k][2]), k + 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


class Automaton:
    """A probabilistic automaton over character classes, and how often each character stands for its class."""

    def __init__(self, counts: list[int], ends: list[int], moves: list[dict], chars: dict[str, int], floor: float = -math.inf):
        self.counts, self.ends, self.moves, self.chars, self.floor = counts, ends, moves, chars, floor
        self.finish()

    def finish(self) -> None:
        kinds: Counter = Counter()
        for c, n in self.chars.items():
            kinds[CLASSES.get(c, c)] += n
        size = Counter(CLASSES.values())
        total = sum(kinds.values())
        self.any = math.log(0.5 / (total + 40))
        #: character -> log of its share of its class
        self.share = {c: math.log((self.chars.get(c, 0) + 0.5) / (kinds[k] + 0.5 * size[k])) for c, k in CLASSES.items()}
        self.steps = [{s: (to, math.log(n / (self.counts[q] + 1))) for s, (to, n) in m.items()} for q, m in enumerate(self.moves)]
        self.lost = [math.log(1 / ((n + 1) * 40)) for n in self.counts]
        self.over = [math.log((e + 0.01) / (n + 1)) for n, e in zip(self.counts, self.ends, strict=True)]
        self.stray = {k: math.log((n + 0.5) / (total + 40)) for k, n in kinds.items()}

    def log_likelihood(self, text: str) -> float:
        """Of the text and its end. A class that a state has never met costs its smoothed share, and shares of classes count from there."""
        q, out = 0, 0.0
        for c in text:
            k = CLASSES.get(c, c)
            out += self.share.get(c, 0.0)
            if q is None:
                out += self.stray.get(k, self.any)
            elif k in self.steps[q]:
                q, p = self.steps[q][k]
                out += p
            else:
                out += self.lost[q]
                q = None
        return out + (self.over[q] if q is not None else self.any)

    def dumps(self) -> str:
        return json.dumps([self.counts, self.ends, self.moves, self.chars, self.floor])

    @classmethod
    def loads(cls, text: str) -> Automaton:
        return cls(*json.loads(text))


def infer(strings: Iterable[str], alpha: float = 0.05) -> Automaton:
    """Merge the states of a prefix tree: a state joins the first settled one that it agrees with, or is settled itself.

    Two states agree if the shares of their ends and of each class, and so on below them, differ by less than Hoeffding's bound
    at ``alpha``.
    """
    counts, ends, moves, chars = [0], [0], [{}], Counter()
    for s in strings:
        q = 0
        chars.update(s)
        counts[0] += 1
        for k in [CLASSES.get(c, c) for c in s]:
            if k not in moves[q]:
                moves[q][k] = [len(counts), 0]
                counts.append(0)
                ends.append(0)
                moves.append({})
            moves[q][k][1] += 1
            q = moves[q][k][0]
            counts[q] += 1
        ends[q] += 1
    wide = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > wide * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def agree(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = counts[a], counts[b]
            if differ(ends[a], n, ends[b], m):
                return False
            for k in moves[a].keys() | moves[b].keys():
                x, y = moves[a].get(k), moves[b].get(k)
                if differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree under ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            counts[a] += counts[b]
            ends[a] += ends[b]
            for k, (to, n) in moves[b].items():
                if k in moves[a]:
                    moves[a][k][1] += n
                    todo.append((moves[a][k][0], to))
                else:
                    moves[a][k] = [to, n]

    settled = [0]
    while True:
        known = set(settled)
        fringe = [(counts[to], q, k, to) for q in settled for k, (to, _) in moves[q].items() if to not in known]
        if not fringe:
            break
        _, q, k, b = max(fringe, key=lambda x: (x[0], -x[3]))
        a = next((r for r in settled if agree(r, b)), None)
        if a is None:
            settled.append(b)
        else:
            moves[q][k][0] = a
            fold(a, b)
    number = {q: i for i, q in enumerate(settled)}
    return Automaton([counts[q] for q in settled], [ends[q] for q in settled], [{k: [number[to], n] for k, (to, n) in moves[q].items()} for q in settled], dict(chars))


def fit(values: list[str], ordinary: bool = False) -> Automaton:
    """The automaton of two thirds of the values; the rest give the floor: the mean log-likelihood a character that 98 in 100 have.

    Ordinary tokens are learned in upper case, too, since headings have any of them so.
    """
    values = sorted(values)
    kept, rest = [v for i, v in enumerate(values) if i % 3], values[::3]
    made = infer([*(kept or rest), *(v.upper() for v in kept if ordinary)])
    per = sorted(made.log_likelihood(v) / len(v) for v in rest)
    made.floor = per[len(per) // 50] - 0.05
    return made


def score(value: str, models: dict[str, Automaton]) -> tuple[str | None, float]:
    """(the kind whose automaton makes the value likeliest, its log-likelihood less the ordinary one's, a character).

    The kind is null where that is no secret: below the kind's floor, or not likelier by MARGIN in all and a tenth a character.
    """
    plain = models[ORDINARY].log_likelihood(value) if ORDINARY in models else 0.0
    kinds = [(m.log_likelihood(value), kind) for kind, m in models.items() if kind != ORDINARY]
    if not kinds:
        return None, 0.0
    best, kind = max(kinds)
    gain = best - plain
    fits = ORDINARY in models and best / len(value) >= models[kind].floor and gain >= max(MARGIN, 0.1 * len(value))
    return kind if fits else None, gain / len(value)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base (spans of patterns) and tokens (what else is scored) of each row; a null text is empty."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * kind.num_fields
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                base, tokens = [], []
                for text in part["text"].to_pylist():
                    base.append(base_spans(text or ""))
                    tokens.append([(ORDINARY, *t) for t in other_tokens(text or "", base[-1])])
                yield pa.RecordBatch.from_arrays([part["id"], structs(base, span), structs(tokens, span)], ["id", "base", "tokens"])

    spans = "array<struct<kind:string,start:int,end:int,value:string>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, base {spans}, tokens {spans}")


def learn(labelled: DataFrame, sample: int = 600, longest: int = 200) -> dict[str, Automaton]:
    """An automaton for each kind of PATTERNS, and for ORDINARY, that ``labelled`` (kind, value) has.

    Of a kind the ``sample`` distinct values with the smallest hashes are learned from, of at most ``longest`` characters; both
    bound what a task and the driver hold, whatever the corpus.
    """
    of = []
    for kind in (*PATTERNS, ORDINARY):
        values = labelled.where((F.col("kind") == kind) & F.length("value").between(1, longest)).select("kind", "value").distinct()
        of.append(values.orderBy(F.xxhash64("value"), "value").limit(sample))
    chosen = of[0]
    for other in of[1:]:
        chosen = chosen.unionAll(other)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [rows["kind"].iloc[0]], "made": [fit(rows["value"].tolist(), rows["kind"].iloc[0] == ORDINARY).dumps()]})

    return {r.kind: Automaton.loads(r.made) for r in chosen.groupBy("kind").applyInPandas(each, "kind string, made string").collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 600) -> DataFrame:
    """``id_col`` and spans (kind, start, end, value, score) of each row, by start and kind.

    Patterns' spans are all there; their score is that of their secret. Further ones are tokens that the automata take for secrets, with
    ``like_`` before the kind. The automata are learned from ``docs`` (see ``learn``); where no pattern finds anything, or there are no
    other tokens to compare with, nothing is added.

    A null text is empty. Repeated rows and ids are rows of their own, ids may be null or of any type, and other columns of ``docs`` aren't read.
    A text of any length is scanned whole, in one task.
    """
    found = cut(scan(docs, id_col, text_col), "secret-candidates")
    labelled = found.select(F.explode(F.concat("base", "tokens")).alias("s")).select("s.kind", "s.value")
    models = learn(labelled, sample)
    order = {k: i for i, k in enumerate([*PATTERNS, *(f"like_{k}" for k in PATTERNS)])}
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, tokens in zip(b["base"].to_pylist(), b["tokens"].to_pylist(), strict=True):
                spans = [s | {"score": score(s["value"], models)[1]} for s in base]
                for t in tokens:
                    kind, gain = score(t["value"], models)
                    if kind:
                        spans.append(t | {"kind": f"like_{kind}", "score": gain})
                rows.append(sorted(spans, key=lambda s: (s["start"], order[s["kind"]])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(rows, kind)], ["id", "spans"])

    return found.mapInArrow(run, f"id {id_type}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
