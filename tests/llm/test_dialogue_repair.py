"""Dialogue repair against a search over all edit sequences, in one task and in runs, and on awkward tables."""

import hashlib
import heapq
import random

import pytest

from cuelattice.llm import dialogue_repair
from cuelattice.llm.dialogue_repair import Turns, dialogue_report, repair_dialogues

SCHEMA = "doc_id long, cue_idx long, speaker_id string, text string, run string, audit int"


def plain(cues):
    """(cost, audit, repaired lines) by best-first search over whole edit sequences."""
    seen, marked = set(), []
    for speaker, text in cues:
        bare = (text or "").strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (speaker, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((speaker, text))
        marked.append((speaker or "", text, fault))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(marked) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        turn = {"u": "user", "a": "assistant"}
        for name in "ua":
            if name in legal[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, name, (*lines, f"{turn[name]}:")))
        if i == len(marked):
            continue
        speaker, text, fault = marked[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
        if fault in ("", "truncated"):
            more = fault == "truncated"
            if speaker[:1] and speaker[:1] in legal[last]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, speaker[:1], (*lines, f"{speaker}:{text}")))
            for name in "ua":
                if name in legal[last]:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, name, (*lines, f"{turn[name]}:{text}")))
    raise AssertionError


def made(dialogues, seed):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "and then", "", "  \n", "Why?", "Yes. ", "ünd so.", None]
    for doc in range(dialogues):
        for cue in range(rng.randrange(0, 14)):
            yield doc, cue, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ulf"]), rng.choice([*said, f"{rng.random()}."]), "x", 1


def reported(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("whole_bytes", [1 << 24, -1])
def test_cheapest_edits_with_the_least_audit(spark, whole_bytes):
    cues = list(made(60, 5))
    got = reported(dialogue_report(repair_dialogues(spark.createDataFrame(cues, SCHEMA), whole_bytes=whole_bytes)))
    by_doc = {}
    for doc, _, speaker, text, *_ in cues:
        by_doc.setdefault(doc, []).append((speaker, text))
    assert set(got) == set(by_doc)
    for doc, own in by_doc.items():
        cost, audit, lines = plain(own)
        # Costs and audits, and the text that comes out of them.
        assert (got[doc].cost, got[doc].audit) == (cost, audit), own
        assert got[doc].sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_a_long_dialogue_in_runs_is_repaired_as_in_one_task(spark):
    rng = random.Random(1)
    cues = [(7, k // 3 if k % 11 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["ja.", f"{k}.", f"{k}", ""]), "x", 1) for k in range(3000)]
    table = spark.createDataFrame(cues, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = repair_dialogues(table, whole_bytes=0)
        assert runs.select("run").distinct().count() > 1
        split = reported(dialogue_report(runs))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split == reported(dialogue_report(repair_dialogues(table)))


def test_checkpoints_are_at_every_square_root_only():
    kinds = [k % 3 for k in range(10_000)]
    side, held = dialogue_repair._checkpoints(kinds, [0] * 10_000, dialogue_repair.END)
    assert side == 101 and len(held) == 101


def test_other_names_of_speakers(spark):
    cues = spark.createDataFrame([(1, 0, "Host", "Hello."), (1, 1, "Host", "Who?"), (1, 2, "Guest", "Me.")], "doc_id long, cue_idx int, speaker_id string, text string")
    repaired = repair_dialogues(cues, Turns("Narrator", "Host", "Guest")).orderBy("run", "place").collect()
    assert [t.speaker_id for r in repaired for t in r.turns] == ["Host", "Guest", "Host", "Guest"]


def test_nulls_ties_repeats_and_empty_tables(spark):
    cues = [(None, None, None, None, "x", 1), (None, 3, "user", "Hi.", "x", 1), (1, 2, "user", "Hi.", "x", 1), (1, 2, "user", "Hi.", "x", 1), (1, 2, "assistant", "Ho." * 40_000, "x", 1)]
    for whole_bytes in (1 << 24, -1):
        got = reported(dialogue_report(repair_dialogues(spark.createDataFrame(cues, SCHEMA), whole_bytes=whole_bytes)))
        assert (got[None].blank, got[None].gaps, got[None].audit) == (1, 0, "DKI")
        assert (got[1].duplicate, got[1].gaps, got[1].audit) == (1, 0, "IKKDI")
        assert repair_dialogues(spark.createDataFrame([], SCHEMA), whole_bytes=whole_bytes).count() == 0
