"""Repair of the structure of conversations by dynamic programming over a grammar.

What a conversation needs depends on the roles and faults of its turns alone, a short string over nine symbols. All
strings are compressed by one grammar, found by rounds of Re-Pair over the whole corpus: every round counts adjacent
pairs in Spark and makes rules of the most frequent ones. A symbol is a matrix from the state before to the state after,
whose entries are the least cost and the edits that have it; a rule's matrix is the product, in which costs add up and
edits are joined as ropes, so it is computed once and shared by all conversations that hold the rule. A conversation is
then the product of the few symbols that its string is compressed to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicloom.llm.common import slices, written

#: Costs and the pattern of role initials that is asked for: ``(s?(ua)+)?``. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after a role initial: 0 nothing yet, 1 after s, 2 after u, 3 after a. None: not allowed.
STATES = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
WANTED = ("u", "u", "a", "u")  # what an inserted or changed turn must be, by the state before it
ENDS = (0, 3)  # states in which a conversation may end
ROLES = {"u": "user", "a": "assistant"}

#: Symbols of a turn: role initial, or x for any other, in lower case if whole and in upper case if truncated; D must go.
SYMBOLS = "suaxSUAXD"
#: The grammar decides how much work is shared, not what comes out. A round halves strings at best.
RULES, ROUNDS = 256, 8  # that a round makes at most; rounds
LEAST = 8  # times that a pair must occur to make a rule: its matrix costs as much as four uses
REMEMBERED = 256  # symbols of a string whose repair a worker remembers, for up to 20,000 strings
BLANKS = " \t\n\x0b\f\r"


class Rope:
    """A string as a tree of joined pieces, so that rules share the strings of their parts."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left: "Rope | str", right: "Rope | None" = None):
        self.left, self.right = left, right
        self.size = len(left) if right is None else left.size + right.size

    def pieces(self) -> Iterator["Rope"]:
        stack = [self]
        while stack:
            rope = stack.pop()
            while rope.right is not None:
                stack.append(rope.right)
                rope = rope.left
            yield rope

    def __str__(self) -> str:
        return "".join(p.left for p in self.pieces())


def less(a: Rope, b: Rope) -> bool:
    """Whether a's string stands before b's. Parts that both share are passed over whole, so no string is built."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if p.right is not None and (p.size >= q.size or q.right is None):
            x += [p.right, p.left]
            y.append(q)
        elif q.right is not None:
            y += [q.right, q.left]
            x.append(p)
        else:
            n = min(p.size, q.size)
            if p.left[:n] != q.left[:n]:
                return p.left[:n] < q.left[:n]
            if p.size > n:
                x.append(Rope(p.left[n:]))
            if q.size > n:
                y.append(Rope(q.left[n:]))
    return bool(y) and any(r.size for r in y)


#: ``matrix[before][after]`` is (cost, rope), or None where no edits lead from one state to the other.
Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def better(a: Entry, b: Entry) -> Entry:
    """The cheaper one; of equal costs the one whose edits stand first. Strings of equal cost never begin one another:
    what the longer had more would be insertions, which cost. So the order stays when both go on alike."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def joined(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return None
    if not a[1].size or not b[1].size:
        return a[0] + b[0], a[1] if a[1].size else b[1]
    return a[0] + b[0], Rope(a[1], b[1])


def row_times(row: tuple[Entry, ...], m: Matrix) -> tuple[Entry, ...]:
    out: list[Entry] = [None] * 4
    for k, first in enumerate(row):
        if first is not None:
            for j in range(4):
                out[j] = better(out[j], joined(first, m[k][j]))
    return tuple(out)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(row_times(row, b) for row in a)


def _insertions() -> Matrix:
    """Insertions before a turn or at the end: up to two lead to any state that insertions can reach."""
    table: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        state, edits = before, ""
        for _ in range(3):
            table[before][state] = better(table[before][state], (INSERT * len(edits), Rope(edits)))
            state, edits = STATES[WANTED[state]][state], edits + "I"
    return tuple(map(tuple, table))


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then one turn kept, changed or deleted."""
    table: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    extra = TRUNCATED if symbol != "D" and symbol.isupper() else 0
    for before in range(4):
        table[before][before] = (DELETE, Rope("D"))
        if symbol == "D":
            continue
        kept = STATES.get(symbol.lower(), (None,) * 4)[before]
        if kept is not None:
            table[before][kept] = better(table[before][kept], (extra, Rope("K")))
        changed = STATES[WANTED[before]][before]
        table[before][changed] = better(table[before][changed], (REROLE + extra, Rope("R")))
    return product(INSERTIONS, tuple(map(tuple, table)))


class Grammar:
    """Rounds of rules ``(left, right) -> symbol`` and the matrix of every symbol, computed from those of its parts."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices: list[Matrix] = [symbol_matrix(s) for s in SYMBOLS]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({pair: len(self.matrices) + i for i, pair in enumerate(pairs)})
        self.matrices += [product(self.matrices[a], self.matrices[b]) for a, b in pairs]

    @staticmethod
    def replaced(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
        """Every pair of a round's rules replaced, from left to right."""
        out, i, last = [], 0, len(symbols) - 1
        while i <= last:
            made = rules.get((symbols[i], symbols[i + 1])) if i < last else None
            out.append(symbols[i] if made is None else made)
            i += 1 if made is None else 2
        return out

    def compressed(self, string: str) -> list[int]:
        symbols = list(map(SYMBOLS.index, string))
        for rules in self.rounds:
            symbols = self.replaced(symbols, rules)
        return symbols

    def repair(self, string: str) -> tuple[int, str]:
        """The least cost and the first edits of that cost."""
        row: tuple[Entry, ...] = ((0, Rope("")), None, None, None)
        for symbol in self.compressed(string):
            row = row_times(row, self.matrices[symbol])
        row = row_times(row, INSERTIONS)
        best = None
        for state in ENDS:
            best = better(best, row[state])
        return best[0], str(best[1])


def chosen(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs, most frequent first, that can be replaced in one round: none ends with a symbol that another begins with."""
    firsts, seconds, pairs = set(), set(), []
    for a, b in counts:
        if a not in seconds and b not in firsts and a != b or (a == b and a not in firsts | seconds):
            pairs.append((a, b))
            firsts.add(a)
            seconds.add(b)
    return pairs


def learn_grammar(strings: DataFrame) -> Grammar:
    """The grammar of ``string, n``: distinct strings of symbols and how often each occurs.

    Pairs are counted in Spark over all strings. A round takes up to ``RULES`` pairs that occur ``LEAST`` times or more
    and don't get in each other's way; only those come to the driver.
    """
    grammar = Grammar()
    spark = strings.sparkSession
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(grammar)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple[int, int], int] = {}
            for batch in batches:
                for string, n in zip(batch.column("string").to_pylist(), batch.column("n").to_pylist()):
                    symbols, last = shared.value.compressed(string), None
                    for pair in zip(symbols, symbols[1:]):
                        if pair == last and pair[0] == pair[1]:  # of three equal symbols only two can go together
                            last = None
                            continue
                        counts[pair] = counts.get(pair, 0) + n
                        last = pair
            yield pa.RecordBatch.from_arrays([
                pa.array([a for a, _ in counts], pa.int32()), pa.array([b for _, b in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ], names=["a", "b", "n"])

        found = strings.mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = found.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "a", "b").limit(RULES).collect()
        if not top:
            break
        grammar = _grown(grammar, chosen([(r["a"], r["b"]) for r in top]))
    return grammar


def _grown(grammar: Grammar, pairs: list[tuple[int, int]]) -> Grammar:
    """A new object, as the one before may still be on its way to a task."""
    new = Grammar()
    new.rounds, new.matrices = list(grammar.rounds), list(grammar.matrices)
    new.add(pairs)
    return new


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by ``crc32`` of ``conv_id:turn``, modulo 20: 0 marks a row as ``dropped``, 1 empties
    the text, 2 takes ``.!?`` out of it, 3 adds a ``copy`` right after the row, 4 makes it the user's.

    Nulls are one space, in that text as well. Rows without a conversation belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    number = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), number).cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("dropped"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def structure(rows: DataFrame) -> DataFrame:
    """``conv_id, string, gaps, blank, duplicate, truncated, illegal`` of damaged rows; dropped ones count for nothing.

    Texts are not shuffled. A conversation whose rows are all dropped has an empty string and zeros.
    """
    ending = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    small = _with_digest(rows).select(
        "conv_id", "turn", "digest", "copy", "dropped", F.left("role", F.lit(1)).alias("initial"), ending.alias("ending")
    )
    order = [F.asc_nulls_first("turn"), "digest", "copy"]
    along = Window.partitionBy("conv_id", "dropped").orderBy(*order)
    same = Window.partitionBy("conv_id", "dropped", "digest").orderBy(*order)
    # Hashed by conversation alone, so that both windows and the sums below need no other shuffle.
    placed = small.repartition("conv_id").select(
        "*", F.row_number().over(along).alias("place"), F.lag("initial").over(along).alias("initial_before"),
        F.lag("turn").over(along).alias("turn_before"), (F.row_number().over(same) > 1).alias("seen"),
    )
    blank, whole = F.col("ending") == "", F.col("ending").isin(".", "!", "?")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(~whole, "truncated")
    symbol = F.when(blank | F.col("seen"), "D").when(whole, letter).otherwise(F.upper(letter))
    marked = placed.withColumns({"fault": fault, "symbol": symbol})

    def count(condition: Column) -> Column:
        return F.count(F.when(~F.col("dropped") & condition, 1))

    pair = F.concat("initial_before", "initial")
    turn = F.when(~F.col("dropped"), F.col("turn"))
    distinct = count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))
    steps = F.array_sort(F.collect_list(F.when(~F.col("dropped"), F.struct("place", "symbol"))))
    return marked.groupBy("conv_id").agg(
        F.array_join(F.transform(steps, lambda x: x["symbol"]), "").alias("string"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - distinct, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def with_repairs(described: DataFrame, grammar: Grammar) -> DataFrame:
    """Add ``cost`` and ``audit`` to rows with a ``string``, in their place and without a shuffle."""
    shared = described.sparkSession.sparkContext.broadcast(grammar)
    schema = T.StructType(list(described.schema)).add("cost", T.LongType()).add("audit", T.StringType())

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value.repair
        remembered = lru_cache(20_000)(whole)
        for batch in batches:
            found = [(remembered if len(x) <= REMEMBERED else whole)(x) for x in batch.column("string").to_pylist()]
            columns = [*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return described.mapInArrow(repair, schema)


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of damaged rows.

    The report has a row per conversation: ``conv_id, string, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    ``audit`` holds the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), of equal cost the one
    that stands first. The turns are ``conv_id, place, edit, role, text``, those of a conversation in a row and in order
    within one partition; a changed turn has another role, an inserted one an empty text. Turns of equal number are in
    the order of a digest of role and text, so repeated rows are neighbours. Conversations that lost all rows are in the
    report only; an empty table gives two empty tables. Texts pass through tasks one by one, so a conversation may be of
    any length; of its structure a task holds a symbol a turn.
    """
    described = written(structure(rows), "structure")
    strings = written(described.where("string <> ''").groupBy("string").agg(F.count(F.lit(1)).alias("n")), "strings")
    report = written(with_repairs(described, learn_grammar(strings)), "repairs")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, place, state = None, "", 0, 0, 0
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            state = STATES[role[:1]][state]
            out.append((conv_id, place, edit, role, text))
            place += 1

        def insert() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                at += 1
                put("I", ROLES[WANTED[state]], "")

        for batch in batches:
            for part in slices([batch]):
                for conv, repair, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                    if repair is not None:
                        insert()
                        conv_id, audit, at, place, state = conv, repair, 0, 0, 0
                        continue
                    insert()
                    step, at = audit[at], at + 1
                    if step != "D":
                        put(step, role if step == "K" else ROLES[WANTED[state]], text)
                yield _turns(out)
                out.clear()
        insert()
        yield _turns(out)

    order = ["conv_id", "is_row", F.asc_nulls_first("turn"), "digest", "copy"]
    texts = _with_digest(rows.where("not dropped")).select(
        "conv_id", F.lit(1).alias("is_row"), "turn", "digest", "copy", F.lit(None).cast("string").alias("audit"), "role", "text"
    )
    # A conversation's audit stands before its turns.
    both = texts.unionByName(report.select("conv_id", F.lit(0).alias("is_row"), "audit"), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    return report, ordered.mapInArrow(edit, "conv_id long, place long, edit string, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "place", "edit", "role", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def digest_of_turns(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns as they come: their ``role:text``, joined by line ends."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going = digest = None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                line = f"{role}:{text}".encode()
                if conv_id == going:
                    digest.update(b"\n" + line)
                    continue
                if going is not None:
                    done.append((going, digest.hexdigest()))
                going, digest = conv_id, hashlib.sha256(line)
            yield _digests(done)
        if going is not None:
            yield _digests([(going, digest.hexdigest())])

    return repaired.select("conv_id", "role", "text").mapInArrow(digests, "conv_id long, repaired_sha256 string")


def _digests(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    columns = [pa.array([c for c, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "repaired_sha256"])
