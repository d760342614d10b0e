"""Conversation structure repair with a suffix-shared automaton.

What a repair may do to a row depends only on the initial of its role and on its first fault, so a conversation is a
word over 16 symbols, its signature, and what the rest of it costs depends only on the rest of the word.

1. *Signatures.*  Rows without their texts are range-partitioned on (conversation, turn) and written as runs of symbols,
   so a conversation of any length is spread over tasks; its runs are joined in order.
2. *Automaton.*  The different signatures of all conversations, sorted from their ends, are the paths of an acyclic
   automaton that is minimised from the end: signatures with one ending share the nodes of that ending.  In that order
   a task holds only the path of the signature before, and makes each further node once.  A node keeps, for each state of
   the grammar, the cost to go and the first edit of the best audit from there, hence the whole audit by following nodes.
3. *Repair.*  Rows and audits meet by conversation, sorted, and are hashed as they pass; no conversation is held.  One
   conversation's hash is taken in one task, because a hash over a text is one chain.

States of the grammar ``(s?(ua)+)?``: nothing yet, after s, after u, after a.  It may end in the first and the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwise.llm.scratch import Scratch

WHITE = " \t\n\x0b\x0c\r"
ROLES, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5

#: What each state expects of a new or renamed row, and where that leads; a kept system row leads from 0 to 1.
_WANTED = ("user", "user", "assistant", "user")
_AFTER = (2, 2, 3, 2)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ORDER = "DIKR"


def symbol(role: Column, fault: Column) -> Column:
    """One letter a to p for the initial of the role and the fault, a place in ``FAULTS``."""
    initial = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    place = F.when((initial == 0) | (role == ""), F.lit(3)).otherwise(initial - 1)
    return F.char(F.lit(ord("a")) + 4 * place + fault)


class Automaton:
    """Nodes of the endings of signatures that come sorted from their ends; a node is its costs and first edits by state."""

    def __init__(self):
        self.word = ""
        self.path = [self.node(None, None)]

    @staticmethod
    def node(letter: str | None, after: tuple | None) -> tuple[tuple[float, ...], str]:
        far = float("inf")
        options: list[dict[str, float]] = [{} for _ in _WANTED]
        if after is None:
            for state in (0, 3):
                options[state]["."] = 0  # the end
        else:
            role, fault = ROLES[(ord(letter) - ord("a")) // 4], FAULTS[(ord(letter) - ord("a")) % 4]
            for state, edits in enumerate(options):
                edits["D"] = DELETE + after[0][state]
                if fault in ("none", "truncated"):
                    extra = UNFINISHED if fault == "truncated" else 0
                    edits["R"] = REROLE + extra + after[0][_AFTER[state]]
                    if (state, role) in _KEPT:
                        edits["K"] = extra + after[0][_KEPT[state, role]]
        cost = [min(edits.values(), default=far) for edits in options]
        for _ in options:
            cost = [min(c, INSERT + cost[_AFTER[state]]) for state, c in enumerate(cost)]
        first = ""
        for state, edits in enumerate(options):
            edits["I"] = INSERT + cost[_AFTER[state]]
            first += min((e for e in edits if edits[e] == cost[state]))
        return tuple(cost), first

    def read(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature; nodes of the ending it shares with the one before are used again."""
        word = signature[::-1]
        shared = 0
        while shared < min(len(word), len(self.word)) and word[shared] == self.word[shared]:
            shared += 1
        del self.path[shared + 1:]
        for letter in word[shared:]:
            self.path.append(self.node(letter, self.path[-1]))
        self.word = word
        state, audit, depth = 0, [], len(word)
        while True:
            edit = self.path[depth][1][state]
            if edit == ".":
                return int(self.path[-1][0][0]), "".join(audit)
            audit.append(edit)
            if edit == "K":
                state = _KEPT[state, ROLES[(ord(word[depth - 1]) - ord("a")) // 4]]
            elif edit != "D":
                state = _AFTER[state]
            depth -= edit != "I"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.read(s) for s in batch["signature"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["signature"], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                                         names=["signature", "cost", "audit"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, range, place, symbols, first, last, turns) of consecutive rows of one conversation, dropped rows left out."""
    place = 0
    for batch in batches:
        conv, symbols, turn = np.array(batch["conv"].to_pylist(), dtype=object), batch["symbol"].to_pylist(), batch["turn"].to_pylist()
        edges = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        rows = []
        for low, high in zip([0, *edges], [*edges, len(conv)], strict=True):
            turns = [t for t, s in zip(turn[low:high], symbols[low:high], strict=True) if s and t is not None]
            rows.append((conv[low], place, "".join(symbols[low:high]), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns))))
            place += 1
        if not len(conv):
            continue
        names, places, text, first, last, count = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([batch["range"][0].as_py()] * len(rows), pa.int32()), pa.array(places, pa.int64()), pa.array(text, pa.string()),
                                          pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(count, pa.int64())],
                                         names=["conv", "range", "place", "symbols", "first", "last", "turns"])


class _Repair:
    """The conversation that passes: its audit and the hash of what it becomes."""

    def __init__(self, facts: tuple, audit: str):
        self.facts, self.audit, self.next, self.state, self.lines, self.hash = facts, audit, 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str, state: int) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, state

    def insert(self) -> None:
        while self.audit[self.next:self.next + 1] == "I":
            self.line(_WANTED[self.state], "", _AFTER[self.state])
            self.next += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.next]
        self.next += 1
        if edit == "K":
            self.line(role, text, _KEPT[self.state, role[:1]])
        elif edit == "R":
            self.line(_WANTED[self.state], text, _AFTER[self.state])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: its facts, audit and hash.  Facts come before the rows of their conversation."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2
    current: _Repair | None = None

    def out(done: list[_Repair]) -> pa.RecordBatch:
        for d in done:
            d.insert()
        rows = [(*d.facts, d.audit, d.hash.hexdigest()) for d in done]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "audit", "repaired_sha256"])

    for batch in batches:
        done = []
        facts = [batch[n] for n in names]
        for i, (kind, role, text, audit) in enumerate(zip(batch["kind"].to_pylist(), batch["role"], batch["text"], batch["audit"], strict=True)):
            if kind:
                current.row(role.as_py(), text.as_py())
            else:
                if current:
                    done.append(current)
                current = _Repair(tuple(f[i].as_py() for f in facts), audit.as_py())
        if done:
            yield out(done)
    if current:
        yield out([current])


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy of the rows as the contract damages them; ``gone`` marks those that it drops.

    By crc32(``conv_id:turn``) modulo 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's.
    Nulls count as one space, but for a null turn's place, which is first.
    """
    space = F.lit(" ")
    name = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    kind = F.pmod(F.crc32(F.concat_ws(":", name["conv_id"], name["turn"])), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(name["text"], ".!?", "")).otherwise(name["text"])
    role = F.when(F.col("kind") == 4, "user").otherwise(name["role"])
    rows = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select(name["conv_id"].alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies)


def repair(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations.

    ``rows``: conv, turn, role, text, copy, gone, as ``damaged`` gives them; rows that are ``gone`` only name their conversation.
    Rows stand by turn (nulls first), then role and hash of the text, so that repeated rows stand together; of repeated rows
    all but the first are duplicates.  A role whose initial is none of s, u, a cannot be kept.  No rows give none.
    """
    with Scratch(rows.sparkSession) as scratch:
        printed = rows.withColumn("print", F.sha2("text", 256))
        # rows alike in everything are dealt out by where they were read, so none of their ranges is too long
        thin = printed.select("conv", "turn", "copy", "gone", "role", "print", F.rtrim("text", F.lit(WHITE)).alias("_body"), F.monotonically_increasing_id().alias("read"))
        unfinished = ~F.substring("_body", -1, 1).isin(".", "!", "?")
        thin = scratch.write(thin.select("*", (F.col("_body") == "").alias("blank"), unfinished.alias("truncated")).drop("_body"), "thin")
        stood = F.struct("turn", "read", "copy")
        alike = thin.where("NOT gone").groupBy("conv", "role", "print").agg(F.count(F.lit(1)).alias("n"), F.min(stood).alias("earliest"))
        alike = scratch.write(alike.where("n > 1").drop("n"), "alike")
        fault = F.when(F.col("blank"), 1).when(F.col("earliest").isNotNull() & ~stood.eqNullSafe(F.col("earliest")), 2).when(F.col("truncated"), 3).otherwise(0)
        letter = F.when(F.col("gone"), "").otherwise(symbol(F.col("role"), fault))
        marked = thin.join(alike, ["conv", "role", "print"], "left").select("conv", "turn", "role", "print", "read", "copy", letter.alias("symbol"))
        marked = scratch.write(marked, "marked")
        order = ["conv", "turn", "role", "print", "read", "copy"]
        ranges = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "symbol", F.spark_partition_id().alias("range"))
        runs = scratch.write(ranges.mapInArrow(_runs, "conv string, range int, place long, symbols string, first long, last long, turns long"), "runs")
        scratch.drop(alike, marked)

        listed = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("range", "place", "symbols", "first", "last", "turns"))).alias("runs"))
        met = F.filter("runs", lambda r: r["turns"] > 0)
        listed = listed.select("conv", F.array_join(F.transform("runs", lambda r: r["symbols"]), "").alias("signature"), met.alias("met"))
        twice = F.zip_with(F.slice("met", 1, F.greatest(F.size("met") - 1, F.lit(0))), F.slice("met", 2, F.size("met")), lambda a, b: (a["last"] == b["first"]).cast("long"))
        # a turn that ends one run and begins the next was counted in both
        turns = F.aggregate("met", F.lit(0).cast("long"), lambda a, r: a + r["turns"]) - F.aggregate(twice, F.lit(0).cast("long"), lambda a, x: a + x)
        gaps = F.when(F.size("met") > 0, F.element_at("met", -1)["last"] - F.element_at("met", 1)["first"] + 1 - turns).otherwise(0)
        listed = scratch.write(listed.select("conv", "signature", gaps.cast("long").alias("gaps")), "conversations")

        words = listed.select("signature").distinct()
        words = words.repartitionByRange(F.reverse(F.substring("signature", -256, 256))).sortWithinPartitions(F.reverse("signature"))
        audits = scratch.write(words.mapInArrow(_audits, "signature string, cost long, audit string"), "audits")
        initials = F.translate("signature", "abcdefghijklmnop", "ssssuuuuaaaa????")
        pairs = F.zip_with(F.split(F.substring("initials", 1, F.length("initials") - 1), ""), F.split(F.expr("substring(initials, 2)"), ""), lambda a, b: F.concat(a, b))
        illegal = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)

        def count(fault: str) -> Column:
            others = "".join(c for i, c in enumerate("abcdefghijklmnop") if i % 4 != FAULTS.index(fault))
            return F.length(F.translate("signature", others, "")).cast("long").alias(fault)

        facts = listed.join(audits, "signature").select("*", initials.alias("initials")).select(
            "conv", F.lit(0).alias("kind"), "gaps", count("blank"), count("duplicate"), count("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit")
        texts = printed.where("NOT gone").select("conv", F.lit(1).alias("kind"), "turn", "role", "print", "text")
        both = texts.unionByName(facts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "print")
        out = both.mapInArrow(_repaired, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
        return scratch.keep(out, "repaired")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of ``conversations`` after damage.

    ``conversations``: conv_id, turn, role, text; further columns are ignored.  Nulls are one space, a null conv_id names
    one conversation.  Repeated rows are rows of their own.  Conversations that lose all rows have zeros, an empty audit
    and the hash of the empty string.
    """
    found = repair(damaged(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")))
    return found.select(F.expr("try_cast(conv AS long)").alias("conv_id"), *found.columns[1:])
