"""Cells, orders, games with known values, and the forward passes."""

import numpy as np
import pytest

from tramline.config import Game
from tramline.models.evaluate import measures, score, target_accuracy_by_role
from tramline.models.forward import build_model, checkpoint_name, lstm, seeded_weights, transformer
from tramline.operators.games import READOUTS, Memo, attribute, cut_cells, exact_shapley, model_value, nested_order, roll_up, sample_masks, segment_starts, winter_values


def seen_cells(cells, masks):
    return np.array([[not (m & c).any() for c in cells.cover] for m in masks])


def test_segments_and_cells():
    assert segment_starts(20, 5).tolist() == [0, 5, 10, 15] and segment_starts(22, 5).tolist() == [0, 2, 7, 12, 17] and segment_starts(10, 5, (0, 3)).tolist() == [0, 3]
    for bad in ((1, 3), (0, 3, 3), (0, 10)):
        with pytest.raises(ValueError, match="ascend"):
            segment_starts(10, 5, bad)
    valid = np.zeros((3, 20), bool)
    valid[0], valid[1, 8:20] = True, True
    valid[1, 15] = False
    cells = cut_cells(valid, np.array([True, True, False]), segment_starts(20, 5), 2)
    assert len(cells) == 14  # four segments of the first agent and three of the second, two channels each
    assert list(zip(cells.agent, cells.segment, cells.channel)) == sorted(zip(cells.agent, cells.segment, cells.channel))
    assert not (cells.cover.any((0, 3)) & ~valid).any() and cells.cover.sum() == 2 * (20 + 11)
    assert not cells.masks(np.ones(14, bool)).any() and np.array_equal(cells.masks(np.zeros(14, bool)), cells.cover.any(0))


@pytest.mark.parametrize("hierarchy", ["agent_major", "time_major"])
@pytest.mark.parametrize("segments", ["uniform", "chrono", "reverse"])
def test_nested_orders(hierarchy, segments):
    cells = cut_cells(np.ones((3, 20), bool), np.ones(3, bool), segment_starts(20, 5), 2)
    order = nested_order(cells, hierarchy, segments, np.random.default_rng(1))
    assert sorted(order) == list(range(len(cells)))
    outer = (cells.agent if hierarchy == "agent_major" else cells.segment)[order]
    assert (np.diff(outer) != 0).sum() == len(set(outer)) - 1  # each stays together
    if segments != "uniform":
        of = cells.segment[order] if hierarchy == "time_major" else cells.segment[order][outer == outer[0]]
        assert (np.diff(of if segments == "chrono" else -of) >= 0).all()


def test_linear_game_gives_its_weights():
    valid = np.ones((2, 8), bool)
    valid[1, :4] = False
    cells = cut_cells(valid, np.ones(2, bool), segment_starts(8, 4), 2)
    w = np.random.default_rng(0).normal(size=len(cells))
    for hierarchy, segments, _ in READOUTS.values():
        memo = Memo(cells, lambda m: 0.25 + seen_cells(cells, m) @ w)
        psi, se, full, empty = winter_values(memo, hierarchy, segments, 1, np.random.default_rng(1))
        assert psi == pytest.approx(w) and (se == 0).all() and full - empty == pytest.approx(psi.sum())


def test_redundant_pair_and_both():
    cells = cut_cells(np.ones((1, 8), bool), np.ones(1, bool), segment_starts(8, 4), 1)
    either = lambda m: seen_cells(cells, m).any(1).astype(float)
    value = {r: winter_values(Memo(cells, either), h, s, 200, np.random.default_rng(2))[0] for r, (h, s, _) in READOUTS.items()}
    assert value["chrono"] == pytest.approx([1, 0]) and value["reverse"] == pytest.approx([0, 1]) and value["symmetric"] == pytest.approx([0.5, 0.5], abs=0.08)
    both = lambda m: seen_cells(cells, m).all(1).astype(float)
    phi, full, empty = exact_shapley(Memo(cells, both), [np.array([0]), np.array([1])])
    assert phi == pytest.approx([0.5, 0.5]) and (full, empty) == (1, 0)
    with pytest.raises(ValueError, match="max_players"):
        exact_shapley(Memo(cells, both), [np.array([0])] * 17)


def test_training_masks():
    valid = np.zeros((7, 80), bool)
    valid[:3, 20:] = True
    agents = np.arange(7) < 3
    a, b = (sample_masks(valid, agents, np.random.default_rng(4)) for _ in range(2))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)) and np.array_equal(a[0], ~valid)
    blocked, channels = sample_masks(valid, agents, np.random.default_rng(4), p_full=1.0)
    assert not channels.any()
    rng = np.random.default_rng(5)
    assert any(sample_masks(valid, agents, rng, p_full=0.0)[1].any() for _ in range(5))


def test_forward_passes_know_masks():
    rng = np.random.default_rng(0)
    x, agents = rng.normal(size=(2, 7, 80, 4)), np.array([[True] * 3 + [False] * 4, [True] * 7])
    w = seeded_weights("transformer", hidden=16)
    conflict, target = transformer(w, x, agents)
    assert conflict.shape == (2,) and target.shape == (2, 6) and np.isneginf(target[0, 2:]).all() and np.isfinite(target[1]).all()
    blocked = np.zeros((2, 7, 80), bool)
    blocked[:, :, :30] = True
    other = x.copy()
    other[:, :, :30] = 99.0
    for f in (lambda v: transformer(w, v, agents, blocked)[0], lambda v: transformer(w, v, agents, None, np.repeat(blocked[..., None], 4, 3))[0], lambda v: lstm(seeded_weights("baseline"), v, agents, blocked)[0]):
        assert f(x) == pytest.approx(f(other))  # what is masked is not read
    assert transformer(w, x, agents, blocked)[0] == pytest.approx(transformer(w, x, agents, None, np.repeat(blocked[..., None], 4, 3))[0])
    assert np.isfinite(transformer(w, x, agents, np.ones((2, 7, 80), bool))[0]).all()
    moved = x.copy()
    moved[0, 5] = 7.0  # an empty slot
    assert transformer(w, moved, agents)[0] == pytest.approx(conflict)
    with pytest.raises(KeyError, match="available"):
        build_model("none")
    assert checkpoint_name("a") == "a_best_model.pt"


def test_lstm_by_hand():
    """One unit, step by step."""
    w = seeded_weights("baseline", features=1, hidden=1, seed=3)
    x = np.array([0.5, -1.0, 2.0])
    h = c = 0.0
    sig = lambda z: 1 / (1 + np.exp(-z))
    for v in x:
        i, f, g, o = (w["encoder.weight_ih_l0"][:, 0] * v + w["encoder.weight_hh_l0"][:, 0] * h + w["encoder.bias_ih_l0"] + w["encoder.bias_hh_l0"])
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
    both = np.array([h, 0.0])  # without neighbours their mean is 0
    z = np.maximum(w["conflict_head.0.weight"] @ both + w["conflict_head.0.bias"], 0) @ w["conflict_head.2.weight"][0] + w["conflict_head.2.bias"][0]
    got = lstm(w, x[None, None, :, None].repeat(2, 1), np.array([[True, False]]))[0]
    assert got[0] == pytest.approx(z)


def test_over_tables(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(6):
        valid = np.zeros((7, 80), bool)
        valid[0], valid[1, 20:], valid[2, 5:70] = True, True, True
        x = np.where(valid[..., None], rng.normal(size=(7, 80, 4)), 0)
        rows.append((e, e % 2, 0 if e % 2 else -1, 7, x.tolist(), valid.tolist()))
    table = spark.createDataFrame(rows, "event_id long, is_conflict int, target_idx long, agent_mask int, x array<array<array<float>>>, valid array<array<boolean>>")
    w = seeded_weights("transformer", hidden=8, layers=1)
    scored = score(table, "transformer", w)
    got = {r["event_id"]: r for r in scored.collect()}
    x, valid = np.array([r[4] for r in rows], "f4").astype(float), np.array([r[5] for r in rows])
    conflict, target = transformer(w, x, np.tile(np.arange(7) < 3, (6, 1)), ~valid)
    assert [got[e]["conflict_logit"] for e in range(6)] == pytest.approx(conflict)
    assert got[0]["target_logits"][2:] == [None] * 4
    m, y = measures(scored).first(), np.arange(6) % 2
    bce = np.maximum(conflict, 0) - conflict * y + np.log1p(np.exp(-abs(conflict)))
    ce = [np.log(np.exp(target[e, :2]).sum()) - target[e, 0] for e in (1, 3, 5)]
    assert m["conflict_loss"] == pytest.approx(bce.mean()) and m["target_loss"] == pytest.approx(np.mean(ce)) and m["loss"] == pytest.approx(bce.mean() + np.mean(ce))
    assert m["target_acc"] == pytest.approx(np.mean([target[e, 0] >= target[e, 1] for e in (1, 3, 5)])) and m["target_samples"] == 3
    assert target_accuracy_by_role(scored).first()["role"] == "front"
    game = Game(seg_len_frames=20, readouts=("symmetric", "chrono"), n_samples=3, exact_agents=(0,))
    cells = attribute(table, "transformer", w, game)
    one, two = (sorted(tuple(r) for r in cells.collect()) for _ in range(2))
    assert one == two
    for e in range(6):
        for r in game.readouts:
            mine = [t for t in one if t[0] == e and t[1] == r]
            assert len(mine) == 4 * (4 + 3 + 4) and abs(mine[0][7] - mine[0][8] - sum(t[5] for t in mine)) < 1e-9
        exact = [t for t in one if t[0] == e and t[1] == "exact"]
        assert len(exact) == 4 and abs(exact[0][7] - exact[0][8] - sum(t[5] for t in exact)) < 1e-9
    sums = [r["psi"] for r in roll_up(cells).where("event_id = 0 and readout = 'chrono'").where("agent is not null and segment is null").collect()]
    assert len(sums) == 3
    with pytest.raises(ValueError, match="needs an event"):
        model_value("transformer", w, x[0], np.arange(7) < 3, valid[0], "target_logit")
    with pytest.raises(RuntimeError, match="valid"):
        attribute(table.drop("valid"), "transformer", w)
