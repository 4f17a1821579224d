"""Secret scans by one combined deterministic automaton.

The rule patterns go through a small regular-expression parser to an NFA that may begin a match at
any byte; subset construction makes it deterministic and minimisation shrinks it. The result is one
flat transition array over byte classes, and a text is read once, byte by byte, for all rules
together. When the automaton reports that a rule has matched, the rule's own reversed automaton
finds where that match begins and its forward one how far it goes.

Matches of a rule are leftmost, as long as possible and do not overlap; a match that fails the
rule's length test still uses up its bytes. This holds for patterns whose earliest-ending match is
the leftmost one, as it is for all that begin with a fixed word or are a single run; the tests compare
the default rules with a backtracking engine.

Edge cases: null text counts as empty and has no spans; spans count code points, whatever the bytes;
a text of any length is one pass; repeated rows give repeated results; other columns pass through,
one named like the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, sliced, table

_ANY = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """``least``: bytes of the whole match; ``value``: bytes from where the pattern is first satisfied."""

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 1
    value: int = 1


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ignore_case=True, value=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published formats of further credentials.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER


class _Parser:
    """Pattern to a tree of ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.s, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s}")
        return node

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        nodes = []
        while self.peek() and self.peek() not in "|)":
            nodes.append(self.quantified())
        return ("cat", nodes)

    def quantified(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign, close = self.peek(), self.s.find("}", self.i)
            if sign == "{":
                low, comma, high = self.s[self.i + 1 : close].partition(",")
                least, most, self.i = int(low), (int(high) if high else None) if comma else int(low), close + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
                self.i += 1
            node = ("rep", node, least, most)
        return node

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 3 if self.s.startswith("(?:", self.i) else 1
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s}")
            self.i += 1
            return node
        if c == "[":
            return self.charset()
        return ("set", self.folded({self.character()}))

    def character(self) -> int:
        c, self.i = self.peek(), self.i + 1
        if c == "\\":
            c, self.i = self.peek(), self.i + 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"unsupported \\{c} in {self.s}")
        return ord(c)

    def charset(self):
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        chars: set[int] = set()
        while self.peek() != "]":
            a = b = self.character()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                b = self.character()
            chars |= set(range(a, b + 1))
        self.i += 1
        chars = self.folded(chars)
        return ("set", _ANY - chars if negated else chars)

    def folded(self, chars) -> frozenset:
        swapped = {ord(chr(c).swapcase()) for c in chars if c < 128} if self.fold else set()
        return frozenset(chars) | swapped


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


def _shortest(node):
    """The pattern cut to where it is first satisfied: what the combined automaton needs to report.

    Without the tails, states of different rules don't multiply while a match goes on.
    """
    if node[0] == "cat" and node[1]:
        tail = _shortest(node[1][-1])
        return _shortest(("cat", node[1][:-1])) if tail == ("cat", []) else ("cat", [*node[1][:-1], tail])
    if node[0] == "alt":
        return ("alt", [_shortest(x) for x in node[1]])
    if node[0] == "rep":
        return ("cat", [*[node[1]] * (node[2] - 1), _shortest(node[1])]) if node[2] else ("cat", [])
    return node


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, begin: int) -> int:
        """Wire the node in after ``begin``; its last state."""
        kind = node[0]
        if kind == "set":
            self.moves[begin].append((node[1], end := self.state()))
            return end
        if kind == "cat":
            for x in node[1]:
                begin = self.add(x, begin)
            return begin
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                self.free[begin].append(a := self.state())
                self.free[self.add(x, a)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            begin = self.add(inner, begin)
        if most is None:
            self.free[begin].append(loop := self.state())
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end := self.state())
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[begin].append(end)
            begin = self.add(inner, begin)
        self.free[begin].append(end)
        return end


def _byte_classes(trees) -> tuple[bytes, list[int]]:
    """A class for each byte, and one byte of each class; bytes no pattern tells apart share one."""
    sets: set[frozenset] = set()

    def walk(node):
        if node[0] == "set":
            sets.add(node[1])
        else:
            for x in node[1] if node[0] in ("cat", "alt") else [node[1]]:
                walk(x)

    for t in trees:
        walk(t)
    names: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    table_ = bytes(names.setdefault(tuple(b in s for s in ordered), len(names)) for b in range(256))
    return table_, [table_.index(c) for c in range(len(names))]


@dataclass
class Dfa:
    """Transitions in one flat list; a state is its row's offset. States from ``hot`` on accept."""

    moves: list[int]
    start: int
    dead: int
    hot: int
    accepts: dict[int, tuple[int, ...]]


def _dfa(trees, samples: list[int], anchored: bool) -> Dfa:
    nfa = _Nfa()
    root = nfa.state()
    if not anchored:
        nfa.moves[root].append((_ANY, root))
    final = {}
    for k, tree in enumerate(trees):
        nfa.free[root].append(begin := nfa.state())
        final[nfa.add(tree, begin)] = k

    def closed(states) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    # subset construction
    known = {(first := closed({root})): 0}
    rows, todo = [], [first]
    for now in todo:
        row = []
        for b in samples:
            then = closed({t for s in now for chars, t in nfa.moves[s] if b in chars})
            if then not in known:
                known[then] = len(known)
                todo.append(then)
            row.append(known[then])
        rows.append(row)
    accepts = [tuple(sorted({final[s] for s in now if s in final})) for now in todo]
    # minimisation: split classes until no transition tells two states of one class apart
    block = {}
    of = [block.setdefault(a, len(block)) for a in accepts]
    while True:
        block = {}
        finer = [block.setdefault((of[s], *(of[t] for t in rows[s])), len(block)) for s in range(len(rows))]
        if len(set(finer)) == len(set(of)):
            break
        of = finer
    one = {}
    for s, b in enumerate(of):
        one.setdefault(b, s)
    order = sorted(one, key=lambda b: (bool(accepts[one[b]]), b))  # accepting states last
    width = len(samples)
    at = {b: i * width for i, b in enumerate(order)}
    moves = [at[of[t]] for b in order for t in rows[one[b]]]
    dead = next((at[b] for b in order if not accepts[one[b]] and all(of[t] == b for t in rows[one[b]])), -1)
    taken = {at[b]: accepts[one[b]] for b in order if accepts[one[b]]}
    return Dfa(moves, at[of[0]], dead, min(taken, default=len(moves)), taken)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [_Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.classes, samples = _byte_classes(trees)
        self.all = _dfa([_shortest(t) for t in trees], samples, anchored=False)
        self.forward = [_dfa([t], samples, anchored=True) for t in trees]
        self.backward = [_dfa([_reversed(t)], samples, anchored=True) for t in trees]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        text = data.translate(self.classes)
        moves, hot, accepts = self.all.moves, self.all.hot, self.all.accepts
        floor, out, s = [0] * len(self.rules), [], self.all.start
        for i, c in enumerate(text):
            s = moves[s + c]
            if s >= hot:
                for k in accepts[s]:
                    if i >= floor[k] and (start := self._begin(k, text, i, floor[k])) >= 0:
                        floor[k] = end = self._end(k, text, start)
                        if end - start >= self.rules[k].least and end - i >= self.rules[k].value:
                            out.append((start, k, end))
        return sorted(out)

    def _begin(self, k: int, text: bytes, last: int, floor: int) -> int:
        d, best = self.backward[k], -1
        s = d.start
        for j in range(last, floor - 1, -1):
            s = d.moves[s + text[j]]
            if s == d.dead:
                break
            if s >= d.hot:
                best = j
        return best

    def _end(self, k: int, text: bytes, start: int) -> int:
        d, best = self.forward[k], start
        s = d.start
        for j in range(start, len(text)):
            s = d.moves[s + text[j]]
            if s == d.dead:
                break
            if s >= d.hot:
                best = j + 1
        return best

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the rules."""
        data = (text or "").encode()
        found = self.spans(data)
        if found and len(data) != len(text):
            place, chars, at = {}, 0, 0
            for b in sorted({x for a, _, e in found for x in (a, e)}):
                chars, at = chars + len(data[at:b].decode()), b
                place[b] = chars
            return [(self.rules[k].kind, place[a], place[e]) for a, k, e in found]
        return [(self.rules[k].kind, a, e) for a, k, e in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One compiled scanner for each set of rules; the driver compiles, executors get it by broadcast."""
    return Scanner(rules)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, column: str = "text", out: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``out``: array<struct<kind,start,end>> of the secrets in the whole text."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))  # as large as the rules make it

    def run(batches):
        find = shared.value
        for b in sliced(batches, column):
            rows = [[dict(zip(("kind", "start", "end"), x)) for x in find(t)] for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _SPANS)], names=[*b.schema.names, out])

    return df.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField(out, SPANS)]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by a mark of its first kind."""
    out, done, stop = [], 0, -1
    for kind, start, end in spans:
        if start < stop:
            stop = max(stop, end)
            continue
        if stop >= 0:
            done = stop
        out += [text[done:start], f"[{kind.upper()}]"]
        stop = end
    return "".join([*out, text[max(done, stop) :]])


def redact(df: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace every secret of the column; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches):
        find = shared.value
        for b in sliced(batches, column):
            texts = pa.array([t if t is None else redacted(t, find(t)) for t in b.column(column).to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index(column), column, texts)

    return df.mapInArrow(released(run), df.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*(r.kind for r in BASE)))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _base_sql() -> str:
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
    kinds = (("assign", f"(?:{names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 12), ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16))
    spans = " UNION ALL ".join(
        f"SELECT row, {n} AS kind, '{kind}' AS name, {least} AS least, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', 1) AS own, regexp_split_to_array(text, '{p}') AS apart FROM x" for n, (kind, p, least) in enumerate(kinds)
    )
    counts = ", ".join(f"CAST(count(name) FILTER (WHERE name = '{kind}') AS BIGINT) AS n_{kind}" for kind, _, _ in kinds)
    return (
        f"WITH x AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), s AS ({spans}),"
        " e AS (SELECT row, kind, name, least, unnest(found) AS found, unnest(own) AS own, unnest(apart[:len(found)]) AS before, unnest(range(len(found))) AS i FROM s WHERE len(found) > 0),"
        " p AS (SELECT row, kind, name, own, least, sum(length(before) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop, length(found) AS size FROM e),"
        " k AS (SELECT row, kind, name, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE length(own) >= least)"
        f" SELECT doc_id, {counts}, sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256 FROM x LEFT JOIN k USING (row) GROUP BY row, doc_id"
    )


SECRETS_BASE_SQL = _base_sql()
