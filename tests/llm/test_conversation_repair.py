"""Repairs against an exhaustive search, and conversations of odd rows."""

import hashlib
import heapq
import random

from inkwitness.llm.conversation_repair import audits, cheapest_edits, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(codes):
    """Cheapest edits by trying all of them, cheapest and ASCII-least first."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, place, roles = heapq.heappop(heap)
        body = roles[1:] if roles[:1] == "s" else roles
        if body != ("ua" * len(body))[:len(body)]:
            continue
        if place == len(codes) and (roles == "" or body and body[-1] == "a"):
            return cost, audit
        if len(audit) < 2 * len(codes) + 3:
            for role in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", place, roles + role))
        if place < len(codes):
            initial, fault = codes[place]
            heapq.heappush(heap, (cost + 3, audit + "D", place + 1, roles))
            if fault not in "bd":
                late = fault == "t"
                if initial in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + late, audit + "K", place + 1, roles + initial))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", place + 1, roles + role))


def test_edits_are_the_cheapest_and_ascii_least():
    draw = random.Random(4)
    for _ in range(250):
        codes = [(draw.choice("ssuuuaaatx"), draw.choice("---bdt")) for _ in range(draw.randrange(6))]
        assert cheapest_edits(codes) == exhaustive(codes), codes


def test_a_long_conversation_takes_linear_time():
    draw = random.Random(5)
    cost, audit = cheapest_edits([(draw.choice("suaat"), draw.choice("--bdt")) for _ in range(20_000)])
    assert len(audit) >= 20_000 and cost > 0


def test_odd_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi!"), (1, 4, "user", " \t"), (1, 5, "user", "Hi!"), (1, 6, "assistant", "Hello"),
            (2, None, None, None), (3, 1, "assistant", "Yes."), (3, 1, "assistant", "Yes."), (None, 7, "user", "Who?"), (None, 8, "assistant", "I.\n"),
            (4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "assistant", "b.")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, audit string").repartition(3)
    got = {r.conv_id: r for r in repair_report(table).collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].cost, got[1].audit) == (1, 1, 1, 1, 2, 7, "KKDDK")
    assert got[1].repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hi!\nassistant:Hello").hexdigest()
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].repaired_sha256) == (0, 1, "D", hashlib.sha256(b"").hexdigest())
    assert (got[3].duplicate, got[3].cost, got[3].audit) == (1, 5, "DIK") or (got[3].duplicate, got[3].cost, got[3].audit) == (1, 5, "IKD")
    assert (got[None].cost, got[None].audit) == (0, "KK") and (got[4].gaps, got[4].audit) == (None, "KK")
    back = repaired_turns(table, audits(table)).where("conv_id = 3").orderBy("place").collect()
    assert [(r.place, r.role, r.text, r.edit) for r in back] == [(1, "user", "", "I"), (2, "assistant", "Yes.", "K")]


def test_an_empty_table(spark):
    assert repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
