"""Order-dependent choices against walks in order."""

import random

import pytest

from ledgerline import plans
from ledgerline.operators import choice


def in_order(drafts):
    seen, out = {}, {}
    for group, place, spans in sorted(drafts, key=lambda d: d[:2]):
        own, held = {s for s in spans or [] if s is not None}, seen.setdefault(group, set())
        out[group, place] = not own & held
        if out[group, place]:
            held |= own
    return out


@pytest.mark.parametrize(("seed", "spans"), [(1, 400), (2, 40), (3, 6)])
def test_random_conflicts_equal_the_walk_in_order(spark, seed, spans):
    rng = random.Random(seed)
    drafts = [(rng.choice("ab"), p, rng.choice([None, []]) if rng.random() < 0.1 else [rng.choice([None, *map(str, range(spans))]) for _ in range(rng.randint(1, 4))]) for p in range(300)]
    got, rounds = choice.first_independent(spark.createDataFrame(drafts, "g string, p int, s array<string>"), ["g"], "p", "s")
    assert {(r["g"], r["p"]): r["kept"] for r in got.collect()} == in_order(drafts)
    assert rounds <= 30 and got.columns == ["g", "p", "s", "kept"]


def test_a_chain_takes_a_round_for_two_of_its_links(spark):
    chain = [("g", p, [str(p), str(p + 1)]) for p in range(8)]
    got, rounds = choice.first_independent(spark.createDataFrame(chain, "g string, p int, s array<string>"), ["g"], "p", "s")
    assert [r["kept"] for r in got.orderBy("p").collect()] == [True, False] * 4 and rounds == 4
    with pytest.raises(RuntimeError):
        choice.first_independent(spark.createDataFrame(chain, "g string, p int, s array<string>"), ["g"], "p", "s", max_rounds=2)


def test_no_conflicts_and_no_drafts(spark):
    some = spark.createDataFrame([("g", 1, ["a"]), ("h", 1, ["a"])], "g string, p int, s array<string>")
    got, rounds = choice.first_independent(some, ["g"], "p", "s")
    assert rounds == 0 and all(r["kept"] for r in got.collect())
    assert choice.first_independent(some.limit(0), ["g"], "p", "s")[0].count() == 0


def test_a_span_backs_one_result(spark):
    rows = [("e", 1, "t1", "quantified", ["a  b", " "], []), ("e", 2, "t2", "quantified", ["a b", "c"], ["x"]), ("e", 3, "t3", "qualitative", ["c"], []), ("e", 4, None, "missing", None, [])]
    got = choice.demoted_results(spark.createDataFrame(rows, "g string, p int, result_text string, result_kind string, result_spans array<string>, flags array<string>"), ["g"], "p").orderBy("p").collect()
    assert [(r["result_text"], r["result_kind"], r["result_spans"], r["flags"]) for r in got] == [
        ("t1", "quantified", ["a b"], []), (None, "missing", [], ["x", "duplicate_outcome_span"]), ("t3", "qualitative", ["c"], []), (None, "missing", None, []),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_new_content_equals_entities_in_turn(spark, seed):
    rng = random.Random(seed)
    turns = {e: t for t, e in enumerate(rng.sample(range(8), 6))}
    existing = [(rng.randrange(8), rng.random() < 0.3, str(rng.randrange(60))) for _ in range(50)]
    drafts = [(rng.randrange(8), p, str(rng.randrange(60))) for p in range(150)]
    claims, want = list(existing), {}
    for e in sorted(turns, key=turns.get):
        seen = {f for owner, reviewed, f in claims if not (owner == e and not reviewed)}
        claims = [c for c in claims if c[0] != e or c[1]]
        for owner, place, f in sorted(drafts):
            if owner == e:
                want[place] = f not in seen
                if want[place]:
                    seen.add(f)
                    claims.append((e, False, f))
    got = choice.new_content(
        spark.createDataFrame(drafts, "entity int, place int, fingerprint string"), spark.createDataFrame(existing, "entity int, reviewed boolean, fingerprint string"), spark.createDataFrame(list(turns.items()), "entity int, turn int")
    ).collect()
    assert {r["place"]: r["duplicate"] is None for r in got if r["duplicate"] != "no_turn"} == want
    assert {r["entity"] for r in got if r["duplicate"] == "no_turn"} == {d[0] for d in drafts} - set(turns)


@pytest.mark.parametrize("walked", [0, 30, 1000])
def test_groups_of_any_size_equal_the_walk_in_order(spark, walked):
    rng = random.Random(walked)
    drafts = [(g, p, rng.choice([None, [], [None]]) if rng.random() < 0.2 else [rng.choice([None, *map(str, range(n))]) for _ in range(rng.randint(1, 4))], {"k": p}) for g, n in [("a", 5), ("b", 60), ("c", 8)] for p in range(8 if g == "c" else 60)]
    rng.shuffle(drafts)
    loose = [(None, 1, ["1"], None), (None, 2, ["1"], None), ("a", None, ["1"], None), ("a", None, ["2"], None)]
    got = choice.kept_in_order(spark.createDataFrame(drafts + loose, "g string, p int, s array<string>, m map<string,int>"), ["g"], "p", "s", walked)
    assert got.columns == ["g", "p", "s", "m", "kept"]
    rows = got.collect()
    want = in_order([d[:3] for d in drafts])
    assert {(r["g"], r["p"]): (r["s"], r["m"]["k"], r["kept"]) for r in rows if r["m"]} == {(g, p): (s, p, want[g, p]) for g, p, s, _ in drafts}
    assert [r["kept"] for r in rows if r["m"] is None] == [True] * 4 and len(rows) == len(drafts) + 4


def test_orders_of_customers_take_no_rounds(spark, sf_dir, monkeypatch):
    tables, write = [], choice.materialize
    monkeypatch.setattr(choice, "materialize", lambda df: tables.append(df) or write(df))
    got = plans.queries()["independent_orders"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count() and len(tables) == 2
