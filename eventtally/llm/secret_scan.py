"""Secret scans by grammar inference.

Three rules find the credentials that are labelled by their surroundings or form.  From
their distinct values a prefix tree is grown for each kind, with counts of arrivals and
ends, and states are merged whose frequencies the Hoeffding bound cannot tell apart,
recursively (Carrasco and Oncina, "Learning stochastic regular grammars by means of a
state merging method").  What is left is a probabilistic automaton of the kind's format;
another is inferred from runs of characters that no rule matches.

Every long run of credential characters is a candidate.  It is scored by its log
likelihood a symbol under each kind's automaton, over that under the automaton of the other
runs; candidates that a format explains as well as its own labelled values, and clearly
better than ordinary text, are spans of their own, named `like_<kind>`.

1. One pass over the texts finds rule spans and candidates; only these are written.
2. At most FIT_VALUES distinct values a kind, picked by a hash, go to one task a kind,
   which infers the automaton; automata have at most FIT_STATES states.
3. One pass over the written candidates scores them.

Defined results: a null text is empty; offsets are code points; a span may overlap one of
another rule, but no `like_` span overlaps a rule's; repeated rows give repeated rows; ids,
null ones too, pass through; without labelled values there are rule spans only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventtally.llm import arrays
from eventtally.llm.tables import stage

# The rules, their least lengths, and the order of kinds.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"), 0, 32),
}
KINDS = tuple(RULES)

#: Characters of a candidate, and how many of them it has at least.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
LEAST_CHARS = 16
_CANDIDATE = re.compile(f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: Texts in which neither a rule nor a candidate can match are passed over.
_SIGNS = f"(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{{12}}|[A-Za-z0-9+/_=-]{{{LEAST_CHARS}}}"

#: Distinct values that an automaton is inferred from, and their greatest length.
FIT_VALUES, FIT_CHARS = 2_000, 256
#: States that an automaton may have; those that would be more are merged with the nearest.
FIT_STATES = 512
#: Chance of telling equal states apart.
ALPHA = 0.05
#: What a symbol that a state has not seen counts, as a part of one.
UNSEEN = 0.5
#: A candidate's likelihood a symbol may fall so far below the labelled values' (their first
#: percentile), and must lie so far above that of ordinary runs; natural logarithms.
BELOW, ABOVE = 0.25, 1.0

ORDINARY = "ordinary"
_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_STOP = len(ALPHABET)


def rule_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the rules' matches, by start and then kind."""
    found = []
    for kind, (pattern, group, least) in RULES.items():
        found += [(kind, *m.span(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def candidates(text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """The runs of credential characters that no rule's span touches."""
    found, at = [], 0
    ends = sorted((start, end) for _, start, end, _ in spans)
    reach = 0
    for m in _CANDIDATE.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach, at = max(reach, ends[at][1]), at + 1
        if reach <= m.start():
            found.append((ORDINARY, *m.span(), m[0]))
    return found


def _scanned(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, spans, runs): the rules' spans and the candidates of every row."""

    def scan(batches):
        for piece in arrays.slices(batches, "text"):
            texts = pc.fill_null(piece.column("text"), "")
            likely = np.flatnonzero(pc.match_substring_regex(texts, _SIGNS).to_numpy(zero_copy_only=False))
            spans: list[list] = [[] for _ in range(len(texts))]
            runs: list[list] = [[] for _ in range(len(texts))]
            for i in likely.tolist():
                whole = texts[i].as_py()
                spans[i] = rule_spans(whole)
                runs[i] = candidates(whole, spans[i])
            yield pa.RecordBatch.from_arrays([piece.column("id"), _span_lists(spans), _span_lists(runs)], names=["id", "spans", "runs"])

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, spans array<{_SPAN}>, runs array<{_SPAN}>")


def _span_lists(lists: list[list]) -> pa.Array:
    flat = [span for spans in lists for span in spans]
    at = np.concatenate([[0], np.cumsum([len(spans) for spans in lists])]).astype(np.int32)
    columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
    types = (pa.string(), pa.int32(), pa.int32(), pa.string())
    fields = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "value"]))


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all values, one after the other, and each value's length."""
    table = np.full(256, 0, np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    return table[np.frombuffer("".join(values).encode(), np.uint8)], np.array([len(v) for v in values], np.int64)


class PrefixTree:
    """States of a prefix tree with the counts of arrivals and ends; merging keeps it deterministic."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.ended = [0], [0]
        self.edges: list[dict[str, int]] = [{}]
        for value in values:
            state = 0
            self.seen[0] += 1
            for symbol in value:
                self.edges[state][symbol] = self.edges[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    for column, empty in ((self.next, {}), (self.edges, {}), (self.seen, 0), (self.ended, 0)):
                        column.append(empty)
                state = self.next[state][symbol]
                self.seen[state] += 1
            self.ended[state] += 1

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether one state's frequencies may be the other's, by the Hoeffding bound."""
        n, m = self.seen[a], self.seen[b]
        bound = np.sqrt(0.5 * np.log(2 / alpha)) * (n**-0.5 + m**-0.5)
        if bound >= 1:
            return True
        if abs(self.ended[a] / n - self.ended[b] / m) > bound:
            return False
        one, other = self.edges[a], self.edges[b]
        return all(abs(one.get(s, 0) / n - other.get(s, 0) / m) <= bound for s in one.keys() | other.keys())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the states, and those that equal symbols lead to, are all alike."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            if not self._alike(a, b, alpha):
                return False
            open_ += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for symbol, count in self.edges[b].items():
                self.edges[a][symbol] = self.edges[a].get(symbol, 0) + count
                if symbol in self.next[a]:
                    open_.append((self.next[a][symbol], self.next[b][symbol]))
                else:
                    self.next[a][symbol] = self.next[b][symbol]

    def distance(self, a: int, b: int) -> float:
        n, m = self.seen[a], self.seen[b]
        one, other = self.edges[a], self.edges[b]
        return sum(abs(one.get(s, 0) / n - other.get(s, 0) / m) for s in one.keys() | other.keys())

    def merged(self, alpha: float = ALPHA, most: int = FIT_STATES) -> list[int]:
        """Merge compatible states; returns those that are left, the first one first."""
        kept = [0]
        known = {0}
        while True:
            border = [(self.seen[child], state, symbol, child) for state in kept for symbol, child in self.next[state].items() if child not in known]
            if not border:
                return kept
            # The best known state first; ties by state and symbol, so the outcome is one.
            _, state, symbol, child = min(border, key=lambda e: (-e[0], e[1], e[2]))
            into = next((old for old in kept if self.compatible(old, child, alpha)), None)
            if into is None and len(kept) < most:
                kept.append(child)
                known.add(child)
                continue
            if into is None:
                into = min(kept, key=lambda old: (self.distance(old, child), old))
            self.next[state][symbol] = into
            self.fold(into, child)


class Automaton:
    """Transitions and log probabilities of the states, a row each; the last column is the end."""

    def __init__(self, to: np.ndarray, cost: np.ndarray):
        self.to, self.cost = to, cost

    @classmethod
    def inferred(cls, values: list[str]) -> Automaton:
        tree = PrefixTree(values)
        states = tree.merged()
        number = {state: i for i, state in enumerate(states)}
        to = np.tile(np.arange(len(states))[:, None], (1, _STOP))
        counts = np.full((len(states), _STOP + 1), UNSEEN / (_STOP + 1))
        for state, i in number.items():
            for symbol, count in tree.edges[state].items():
                at = ALPHABET.index(symbol)
                to[i, at] = number[tree.next[state][symbol]]
                counts[i, at] += count
            counts[i, _STOP] += tree.ended[state]
        return cls(to, np.log(counts / counts.sum(axis=1, keepdims=True)))

    def scores(self, values: list[str]) -> np.ndarray:
        """Log likelihood a symbol, the end counting as one, of each value; position by position for all at once."""
        codes, sizes = _codes(values)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        state = np.zeros(len(values), np.int64)
        total = np.zeros(len(values))
        for place in range(int(sizes.max(initial=0))):
            order = order[: np.searchsorted(-sizes[order], -place, "left")]
            code = codes[begins[order] + place]
            total[order] += self.cost[state[order], code]
            state[order] = self.to[state[order], code]
        return (total + self.cost[state, _STOP]) / (sizes + 1)


def fit(scanned: DataFrame, fit_values: int = FIT_VALUES) -> dict[str, tuple[Automaton, float]]:
    """Each kind's automaton, and the first percentile of its labelled values' scores."""
    each = scanned.select(F.explode(F.concat("spans", "runs")).alias("span")).select("span.kind", "span.value")
    values = each.where(F.length("value") <= FIT_CHARS).distinct()
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    picked = values.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= fit_values)

    def infer(group: pa.Table) -> pa.Table:
        listed = sorted(group.column("value").to_pylist())
        automaton = Automaton.inferred(listed)
        floor = float(np.quantile(automaton.scores(listed), 0.01))
        return pa.table({
            "kind": [group.column("kind")[0].as_py()], "to": [automaton.to.astype(np.int32).tobytes()],
            "cost": [automaton.cost.tobytes()], "floor": [floor],
        })

    # A row a kind, with at most FIT_STATES states.
    rows = picked.groupBy("kind").applyInArrow(infer, "kind string, to binary, cost binary, floor double").collect()
    return {
        row["kind"]: (
            Automaton(
                np.frombuffer(row["to"], np.int32).reshape(-1, _STOP), np.frombuffer(row["cost"]).reshape(-1, _STOP + 1)
            ), row["floor"],
        )
        for row in rows
    }


def _judged(spans: pa.Array, model: dict, below: float, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates the best kind (its number, or -1) and its score above ordinary text."""
    values = spans.field("value").to_pylist()
    best, kind = np.full(len(values), -np.inf), np.full(len(values), -1)
    if not values:
        return kind, best
    if ORDINARY in model:
        usual = model[ORDINARY][0].scores(values)
    else:
        usual = np.full(len(values), -np.log(_STOP + 1))
    for i, name in enumerate(KINDS):
        if name in model:
            automaton, floor = model[name]
            own = automaton.scores(values)
            better = (own >= floor - below) & (own - usual >= above) & (own - usual > best)
            kind[better], best[better] = i, (own - usual)[better]
    return kind, best


def scan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", fit_values: int = FIT_VALUES,
    below: float = BELOW, above: float = ABOVE,
) -> DataFrame:
    """(id, spans): every row's spans (kind, start, end, value, score) by start, then kind.

    The rules' spans come with a null score; `like_` spans have what their format's
    likelihood a symbol exceeds that of ordinary runs by.
    """
    found = stage(_scanned(docs, id_column, text), "secret-spans")
    model = fit(found, fit_values)
    names = pa.array([f"like_{kind}" for kind in KINDS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat = runs.flatten()
            kind, best = _judged(flat, model, below, above)
            hit = np.flatnonzero(kind >= 0)
            row = np.repeat(np.arange(len(runs)), np.diff(np.asarray(runs.offsets)))[hit]
            at = np.searchsorted(row, np.arange(len(runs) + 1)).astype(np.int32)
            fields = [names.take(pa.array(kind[hit])), *[flat.field(c).take(pa.array(hit)) for c in ("start", "end", "value")], pa.array(best[hit])]
            more = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "value", "score"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("spans"), more], names=["id", "spans", "more"])

    kind = found.schema["id"].dataType.simpleString()
    scored_span = "struct<kind:string,start:int,end:int,value:string,score:double>"
    scored = found.mapInArrow(score, f"id {kind}, spans array<{_SPAN}>, more array<{scored_span}>")
    own = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("double").alias("score")))
    return scored.select("id", _sorted(F.concat(own, F.col("more"))).alias("spans"))


def _sorted(spans: Column) -> Column:
    order = F.array(*[F.lit(kind) for kind in (*KINDS, *[f"like_{kind}" for kind in KINDS])])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
