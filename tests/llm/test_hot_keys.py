"""Keys that stand on many rows, by results and by plan."""

from parley.llm import substring_dedup

from .conftest import table
from .test_brute import cut_by_hand


def test_an_anchor_in_many_surroundings_is_not_one_group(spark, monkeypatch):
    """No window function gathers the runs of an anchor before they are marked."""
    plans, staged = [], substring_dedup.staged

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df)

    monkeypatch.setattr(substring_dedup, "staged", noted)
    line = "one line that stands in very many places of this table"
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(12)), line, *(f"b{i % 40}x{j}" for j in range(12))])) for i in range(120)]
    got = substring_dedup.remove_repeats(table(spark, rows + rows[:2])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == cut_by_hand(rows, 20)
    assert plans and not [p for p in plans if "Window [" in p]
