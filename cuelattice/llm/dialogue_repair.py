"""Structure repair of captioned dialogues: the cheapest edits that make speakers take turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.records import arrow_batches, only
from cuelattice.session import cut_lineage

#: What a character of a word and the end of a sentence are, and what an edit costs.
SPEECH = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1

#: Faults of a cue.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Kinds of speakers, and what was said last: nothing, the opener's, the first's or the second's cue.
OPENER, FIRST, SECOND, OTHER = 0, 1, 2, 3
NOTHING, OPENED, ASKED, ANSWERED = 0, 1, 2, 3
#: State after the next turn from each state; every turn but the answer to a question is a question.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
NEVER = 1 << 60

REPAIRED = ("doc_id {doc}, run int, place long, cue_idx {cue}, speaker_id string, steps string, "
            "turns array<struct<speaker_id: string, text: string>>, blank int, duplicate int, truncated int, illegal int, cost int")
_NARROW = "doc_id {doc}, run int, cue_idx {cue}, speaker_id string, digest binary"


@dataclass(frozen=True)
class Turns:
    """Names of the speakers of a dialogue: an opener once at most, then the first and the second in turn."""

    opener: str = "system"
    first: str = "user"
    second: str = "assistant"

    def kind(self, speaker: str | None) -> int:
        return {self.opener[:1]: OPENER, self.first[:1]: FIRST, self.second[:1]: SECOND}.get((speaker or "")[:1] or None, OTHER)

    def named(self, state: int) -> str:
        return self.first if state == ASKED else self.second


def _with_inserts(v: list[int]) -> list[int]:
    """Costs when cues may be put in before anything else happens."""
    asked, answered = min(v[ASKED], INSERT + v[ANSWERED]), min(v[ANSWERED], INSERT + v[ASKED])
    return [min(v[NOTHING], INSERT + asked), min(v[OPENED], INSERT + asked), asked, answered]


def _kept(kind: int, state: int) -> int:
    """State after a cue that stays as it is, -1 where it can't stay."""
    if kind == OPENER:
        return OPENED if state == NOTHING else -1
    return NEXT[state] if kind in (FIRST, SECOND) and (kind == FIRST) == (NEXT[state] == ASKED) else -1


def _before(kind: int, fault: int, after: list[int]) -> list[int]:
    """Costs to the end before a cue, from the costs after it."""
    costs = [DELETE + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        more = UNFINISHED if fault == TRUNCATED else 0
        for state in range(4):
            to = _kept(kind, state)
            costs[state] = min(costs[state], REROLE + more + after[NEXT[state]], more + after[to] if to >= 0 else NEVER)
    return _with_inserts(costs)


#: Costs after the last cue.
END = _with_inserts([0, NEVER, NEVER, 0])


def _checkpoints(kinds: Sequence[int], faults: Sequence[int], end: list[int]) -> tuple[int, list[list[int]]]:
    """Backward costs at every ``isqrt(n) + 1``-th cue only; entry k is before cue k * side, the last one after the end."""
    n = len(kinds)
    side = isqrt(n) + 1
    held, v = [end], end
    for i in range(n - 1, -1, -1):
        v = _before(kinds[i], faults[i], v)
        if i % side == 0:
            held.append(v)
    return side, held[::-1]


def _walk(kinds: Sequence[int], faults: Sequence[int], end: list[int], state: int, last: bool) -> Iterator[tuple[int, str, int]]:
    """The ASCII-least cheapest edits, one by one: (cue, edit, state after it); cue n is the end of the run."""
    side, held = _checkpoints(kinds, faults, end)
    n = len(kinds)
    for block in range(len(held) - 1):
        low, high = block * side, min(n, (block + 1) * side)
        vectors = [held[block + 1]]
        for i in range(high - 1, low - 1, -1):
            vectors.append(_before(kinds[i], faults[i], vectors[-1]))
        vectors.reverse()
        for i in range(low, high):
            here, after = vectors[i - low], vectors[i - low + 1]
            more = UNFINISHED if faults[i] == TRUNCATED else 0
            while True:
                cost, to = here[state], _kept(kinds[i], state)
                if cost == DELETE + after[state]:
                    yield i, "D", state
                    break
                if cost == INSERT + here[NEXT[state]]:
                    state = NEXT[state]
                    yield i, "I", state
                    continue
                if to >= 0 and cost == more + after[to]:
                    state = to
                    yield i, "K", state
                    break
                state = NEXT[state]
                yield i, "R", state
                break
    # What is left at the end of a run that is the last one of its dialogue.
    while last and end[state]:
        state = NEXT[state]
        yield n, "I", state


def _exits(kinds: Sequence[int], faults: Sequence[int], end: list[int]) -> list[int]:
    """State at the end of a run for each state at its start."""
    out = []
    for state in range(4):
        for _, _, state in _walk(kinds, faults, end, state, False):  # noqa: B007, B020, PLW2901
            pass
        out.append(state)
    return out


def _transfer(kinds: Sequence[int], faults: Sequence[int]) -> list[int]:
    """Least costs of a run from each state at its start to each state at its end, row by row."""
    columns = [[0 if s == t else NEVER for s in range(4)] for t in range(4)]
    for i in range(len(kinds) - 1, -1, -1):
        columns = [_before(kinds[i], faults[i], c) for c in columns]
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


def _fold_runs(runs: list[dict[str, Any]]) -> list[list[int]]:
    """Costs at the end of each run of a dialogue, from the transfers of its runs in order."""
    v, ends = END, []
    for run in reversed(runs):
        ends.append(v)
        m = run["transfer"]
        v = [min(NEVER, *(m[4 * s + t] + v[t] for t in range(4))) for s in range(4)]
    return ends[::-1]


def _rows_of(kinds: Sequence[int], faults: Sequence[int], end: list[int], state: int, before: int, last: bool = True) -> Iterator[tuple[int, list[tuple[str, int]], int, int]]:
    """Per cue and for what follows the last: (cue, edits with the states after them, cost, illegal step from the cue before)."""
    n = len(kinds)
    for i, steps in groupby(_walk(kinds, faults, end, state, last), key=lambda step: step[0]):
        edits = [(edit, to) for _, edit, to in steps]
        cost = sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit] for edit, _ in edits)
        if i == n:
            yield n, edits, cost, 0
            continue
        if edits[-1][0] != "D" and faults[i] == TRUNCATED:
            cost += UNFINISHED
        prior = before if i == 0 else kinds[i - 1]
        yield i, edits, cost, int(prior >= 0 and (prior, kinds[i]) not in ((OPENER, FIRST), (FIRST, SECOND), (SECOND, FIRST)))


def _turns_of(edits: list[tuple[str, int]], speaker: str | None, text: str | None, turns: Turns) -> list[dict[str, str | None]]:
    made = {"I": lambda to: {"speaker_id": turns.named(to), "text": ""}, "R": lambda to: {"speaker_id": turns.named(to), "text": text},
            "K": lambda _: {"speaker_id": speaker, "text": text}}
    return [made[edit](to) for edit, to in edits if edit != "D"]


def _fault(text: Column) -> Column:
    """Blank or truncated; duplicates are seen only beside the other cues."""
    return (F.when(~F.coalesce(text.rlike(SPEECH), F.lit(False)), BLANK).when(~text.rlike(ENDED), TRUNCATED).otherwise(SOUND)).cast("int")


def _sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict[str, Any]]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in keys))


def _packed(rows: Iterator[dict[str, Any]], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"] or "") for t in row.get("turns") or ())
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow_schema(cues: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = {f.name: f.dataType.simpleString() for f in cues.schema.fields}
    text = ddl.format(doc=types["doc_id"], cue=types["cue_idx"])
    return text, to_arrow_schema(StructType.fromDDL(text))


def _whole(cues: DataFrame, turns: Turns) -> DataFrame:
    """Repair of dialogues of which each fits in a task: dealt once, text and all."""
    ddl, schema = _arrow_schema(cues, REPAIRED)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, Any]]:
            for (doc,), group in _sorted_groups(batches, "doc_id"):
                held, seen, faults = list(group), set(), []
                for row in held:
                    said = (row["speaker_id"], row["digest"])
                    faults.append(DUPLICATE if row["fault"] != BLANK and said in seen else row["fault"])
                    seen.add(said)
                kinds = [turns.kind(row["speaker_id"]) for row in held]
                for i, edits, cost, illegal in _rows_of(kinds, faults, END, NOTHING, -1):
                    own = held[i] if i < len(held) else {"cue_idx": None, "speaker_id": None, "text": None}
                    fault = faults[i] if i < len(held) else SOUND
                    yield {
                        "doc_id": doc, "run": 0, "place": i, "cue_idx": own["cue_idx"], "speaker_id": own["speaker_id"],
                        "steps": "".join(e for e, _ in edits), "turns": _turns_of(edits, own["speaker_id"], own["text"], turns),
                        "blank": int(fault == BLANK), "duplicate": int(fault == DUPLICATE), "truncated": int(fault == TRUNCATED),
                        "illegal": illegal, "cost": cost,
                    }
        return _packed(rows(), schema)

    dealt = cues.repartition("doc_id").sortWithinPartitions("doc_id", "cue_idx", "speaker_id", "digest")
    return dealt.mapInArrow(repair, ddl)


def _expanded(group: Iterator[dict[str, Any]], turns: Turns) -> tuple[list[dict[str, Any]], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a run, and for every copy of them its row, kind and fault; a copy after the first of all repeats it."""
    held = list(group)
    copies = np.array([row["copies"] for row in held], dtype=np.int64)
    owner = np.repeat(np.arange(len(held)), copies)
    kinds = np.repeat(np.array([turns.kind(row["speaker_id"]) for row in held], dtype=np.int8), copies)
    own = np.array([row["fault"] for row in held], dtype=np.int8)
    later = np.where(own == BLANK, BLANK, DUPLICATE).astype(np.int8)
    faults = np.repeat(later, copies)
    starts = np.cumsum(copies) - copies
    faults[starts] = np.where(np.array([row["leads"] for row in held], dtype=bool), own, later)
    return held, owner, kinds, faults


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    together = [a[k].eqNullSafe(b[k]) for k in keys]
    return together[0] if len(together) == 1 else together[0] & _same(a, b, *keys[1:])


def _long(cues: DataFrame, turns: Turns) -> DataFrame:
    """Repair of dialogues of any length: narrow rows dealt by range, runs joined by their transfers, texts joined last.

    Equal cues are one row with a count. A run is what one range partition holds of a dialogue; costs between the
    runs of a dialogue come from 4 x 4 transfers, states from the walks of each run, and both are folded over the few
    runs, never over cues.
    """
    keys = ["doc_id", "cue_idx", "speaker_id", "digest"]
    narrow = cues.select(*keys, "fault")
    leads = narrow.groupBy("doc_id", "speaker_id", "digest").agg(F.min(F.struct(F.col("cue_idx").isNotNull().alias("there"), "cue_idx")).alias("least"))
    counted = narrow.groupBy(*keys).agg(F.max("fault").alias("fault"), F.count("*").alias("copies"))
    marked = counted.withColumn("leads", F.lit(False)).unionByName(
        leads.select("doc_id", F.col("least.cue_idx").alias("cue_idx"), "speaker_id", "digest", F.lit(None).cast("int").alias("fault"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("leads")))
    rows = marked.groupBy(*keys).agg(F.max("fault").alias("fault"), F.sum("copies").alias("copies"), F.max("leads").alias("leads"))
    ranged = cut_lineage(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("run", F.spark_partition_id())
    table = cut_lineage(ranged)
    several = table.select("doc_id", "run").distinct().groupBy("doc_id").agg(F.count("*").alias("runs")).where("runs > 1").drop("runs")
    spread = cut_lineage(table.join(several, _same(table, several, "doc_id"), "left_semi"))

    def by_run(df: DataFrame) -> DataFrame:
        return df.repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "cue_idx", "speaker_id", "digest")

    transfer_ddl, transfer_schema = _arrow_schema(cues, "doc_id {doc}, run int, last int, transfer array<bigint>")
    end_ddl, end_schema = _arrow_schema(cues, "doc_id {doc}, run int, before int, final boolean, ends array<bigint>")
    exit_ddl, exit_schema = _arrow_schema(cues, "doc_id {doc}, run int, before int, final boolean, ends array<bigint>, exits array<int>")
    start_ddl, start_schema = _arrow_schema(cues, "doc_id {doc}, run int, before int, final boolean, ends array<bigint>, state int")

    def transfers(batches):
        return _packed(({"doc_id": doc, "run": run, "last": int(kinds[-1]), "transfer": _transfer(kinds.tolist(), faults.tolist())}
                        for (doc, run), group in _sorted_groups(batches, "doc_id", "run") for _, _, kinds, faults in [_expanded(group, turns)]), transfer_schema)

    def ends(batches):
        def rows():
            for (doc,), group in _sorted_groups(batches, "doc_id"):
                runs = list(group)
                for k, end in enumerate(_fold_runs(runs)):
                    yield {"doc_id": doc, "run": runs[k]["run"], "before": runs[k - 1]["last"] if k else -1, "final": k == len(runs) - 1, "ends": end}
        return _packed(rows(), end_schema)

    def exits(batches):
        def rows():
            for (doc, run), group in _sorted_groups(batches, "doc_id", "run"):
                held, _, kinds, faults = _expanded(group, turns)
                own = held[0]
                yield {"doc_id": doc, "run": run, "before": own["before"], "final": own["final"], "ends": own["ends"],
                       "exits": _exits(kinds.tolist(), faults.tolist(), list(own["ends"]))}
        return _packed(rows(), exit_schema)

    def starts(batches):
        def rows():
            for (_,), group in _sorted_groups(batches, "doc_id"):
                state = NOTHING
                for row in group:
                    yield {k: row[k] for k in ("doc_id", "run", "before", "final", "ends")} | {"state": state}
                    state = row["exits"][state]
        return _packed(rows(), start_schema)

    def by_doc(df: DataFrame) -> DataFrame:
        return df.repartition("doc_id").sortWithinPartitions("doc_id", "run")

    def beside(df: DataFrame, notes: DataFrame, how: str) -> DataFrame:
        return df.join(notes, _same(df, notes, "doc_id", "run"), how).select(df["*"], *[notes[c] for c in notes.columns if c not in ("doc_id", "run")])

    run_ends = cut_lineage(by_doc(by_run(spread).mapInArrow(transfers, transfer_ddl)).mapInArrow(ends, end_ddl))
    run_starts = cut_lineage(by_doc(by_run(beside(spread, run_ends, "inner")).mapInArrow(exits, exit_ddl)).mapInArrow(starts, start_ddl))

    edit_ddl, edit_schema = _arrow_schema(cues, _NARROW + ", place bigint, steps string, turns array<struct<speaker_id: string, text: string>>, own int, "
                                          "blank int, duplicate int, truncated int, illegal int, cost int")

    def edits(batches):
        def rows():
            for (doc, run), group in _sorted_groups(batches, "doc_id", "run"):
                held, owner, kinds, faults = _expanded(group, turns)
                own, n = held[0], len(owner)
                last = own["final"] is not False
                end = END if last else list(own["ends"])
                kinds_, faults_ = kinds.tolist(), faults.tolist()
                state, before = (own["state"], own["before"]) if own["state"] is not None else (NOTHING, -1)
                for i, steps, cost, illegal in _rows_of(kinds_, faults_, end, state, before, last):
                    row = held[owner[i]] if i < n else {"cue_idx": None, "speaker_id": None, "digest": None}
                    fault = faults_[i] if i < n else SOUND
                    # The text is joined later: its place among the turns is noted.
                    made = _turns_of(steps, row["speaker_id"], None, turns)
                    yield {"doc_id": doc, "run": run, "cue_idx": row["cue_idx"], "speaker_id": row["speaker_id"], "digest": row["digest"], "place": i,
                           "steps": "".join(e for e, _ in steps), "turns": made, "own": len(made) - 1 if steps[-1][0] in "KR" else -1,
                           "blank": int(fault == BLANK), "duplicate": int(fault == DUPLICATE), "truncated": int(fault == TRUNCATED), "illegal": illegal, "cost": cost}
        return _packed(rows(), edit_schema)

    edited = cut_lineage(by_run(beside(table, run_starts, "left")).mapInArrow(edits, edit_ddl))
    said = cues.groupBy(*keys).agg(F.first("text").alias("text"))
    kept = edited.where("own >= 0")
    worded = kept.join(said, _same(kept, said, *keys), "left").select(kept["*"], said["text"])
    whole = worded.unionByName(edited.where("own < 0").withColumn("text", F.lit(None).cast("string")))
    filled = F.transform("turns", lambda t, i: F.when(i == F.col("own"), F.struct(t["speaker_id"].alias("speaker_id"), F.col("text").alias("text"))).otherwise(t))
    return whole.select("doc_id", "run", "place", "cue_idx", "speaker_id", "steps", filled.alias("turns"), "blank", "duplicate", "truncated", "illegal", "cost")


def repair_dialogues(cues: DataFrame, turns: Turns = Turns(), whole_bytes: int = 16 << 20) -> DataFrame:  # noqa: B008
    """Cheapest repair of the dialogue in each caption document, one row per cue and one for what follows the last.

    ``cues`` has ``doc_id``, ``cue_idx``, ``speaker_id`` and ``text``; other columns are ignored. Cues stand by
    ``cue_idx`` (nulls first), then speaker and the digest of the text. The first fault of a cue counts: ``blank`` (no
    character but white space; null counts), ``duplicate`` (speaker and text seen earlier), ``truncated`` (does not end
    in ``.``, ``!`` or ``?``). Speakers count by their first character; a repaired dialogue is empty, or has the opener
    once at most and then first and second in turn. Keeping a cue costs 0, giving it the first's or second's name 2
    (R), deleting it 3 (D, required for blank and duplicate), an added empty cue 2 (I), and 1 more a truncated cue that
    is not deleted. Among the cheapest edits the ASCII-least sequence is taken.

    Returns ``doc_id``, ``run`` and ``place`` (order within the document), ``cue_idx``, ``speaker_id``, ``steps``
    (letters up to this cue's own edit), ``turns`` (what the repaired dialogue has there), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (1 if the speaker may not follow that of the cue before) and ``cost``. Null document
    ids are one document, null speakers one other speaker; equal rows stand beside each other; empty tables give none.

    The dynamic programme holds backward costs of the four states at every square root of n-th cue only and computes
    the block between two of them again while it walks forward. A document of at most ``whole_bytes`` is repaired
    in one task after one shuffle. Larger ones are cut into the runs of a range partitioning and repaired run by run,
    as many tasks as they need; both ways give the same edits.
    """
    arrow_batches(cues.sparkSession)
    own = only(cues, "doc_id", "cue_idx", "speaker_id", "text")
    rows = own.select(
        "doc_id", "cue_idx", F.col("speaker_id").cast("string").alias("speaker_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), _fault(F.col("text")).alias("fault"))
    weight = own.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("weight"))
    large = cut_lineage(weight.where(F.col("weight") > whole_bytes).select("doc_id"))
    if not large.take(1):
        return _whole(rows, turns)
    long = _long(rows.join(large, _same(rows, large, "doc_id"), "left_semi"), turns)
    return _whole(rows.join(large, _same(rows, large, "doc_id"), "left_anti"), turns).unionByName(long)


def dialogue_report(repaired: DataFrame) -> DataFrame:
    """One row per document of ``repair_dialogues``: what was found, what it cost and what came out.

    Returns ``doc_id``, ``gaps`` (numbers missing between the least and the greatest ``cue_idx``; nulls ignored),
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` (all edits in order) and ``sha256`` of the
    repaired ``speaker:text`` lines. Rows stream by in order, so a document takes memory for its audit only.
    """
    ddl, schema = _arrow_schema(repaired, "doc_id {doc}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha256 string")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, Any]]:
            for (doc,), group in _sorted_groups(batches, "doc_id"):
                sums, audit, digest, lines = dict.fromkeys(counts, 0), [], hashlib.sha256(), 0
                least = last = None
                distinct = 0
                for row in group:
                    for name in counts:
                        sums[name] += row[name]
                    audit.append(row["steps"])
                    for turn in row["turns"]:
                        digest.update((b"\n" if lines else b"") + f"{turn['speaker_id'] or ''}:{turn['text'] or ''}".encode())
                        lines += 1
                    cue = row["cue_idx"]
                    if cue is not None and cue != last:
                        least, last, distinct = cue if least is None else least, cue, distinct + 1
                gaps = last - least + 1 - distinct if distinct else 0
                yield {"doc_id": doc, "gaps": gaps, **sums, "audit": "".join(audit), "sha256": digest.hexdigest()}
        return _packed(rows(), schema)

    return repaired.repartition("doc_id").sortWithinPartitions("doc_id", "run", "place").mapInArrow(report, ddl)
