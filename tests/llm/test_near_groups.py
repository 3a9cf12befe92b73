"""One group of copies with one to seven words exchanged: components, whatever the sizes of blocks and salts."""

import random

import pytest

from tesseral.llm import near_dedup as module
from tesseral.llm.near_dedup import block_links, near_dedup

from .conftest import docs
from .test_dedup import brute_components, sets_of


def variants(n, seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(150)]
    out = [(7, " ".join(words))]
    for k in range(n):
        mine = list(words)
        for _ in range(random.randint(1, 7)):
            # few replacements, so that copies share some of them
            mine[random.randrange(150)] = f"r{random.randrange(4)}"
        out.append((1000 + k, " ".join(mine)))
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "SALT", 8)
    table = variants(160, 11)
    expected = brute_components(sets_of(table), 85)
    assert len(set(expected.values())) > 5
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, table)).collect()} == expected


def test_a_home_too_large_to_be_held_together(spark, monkeypatch):
    monkeypatch.setattr(module, "HOME", 20)
    table = variants(120, 3)
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, table)).collect()} == brute_components(sets_of(table), 85)


def test_block_links_join_what_is_linked():
    table = variants(60, 5)
    sets = sets_of(table)
    ids = [d for d, _ in table]
    found = block_links([t for _, t in table], ids, ids, 85, 5)
    linked = {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert set(found) == linked
    assert block_links(["a b", "c d"], [1, 2], [1, 2], 85, 5) == []


def test_few_pairs_of_a_large_group_are_rows(spark, monkeypatch):
    """Copies of which few are linked: what is asked of signatures grows with the members, not with their square."""
    random.seed(5)
    words = [f"w{k}" for k in range(150)]
    table = []
    for k in range(600):
        mine = list(words)
        for place in random.sample(range(150), random.randint(4, 9)):
            mine[place] = f"r{k}.{place}"
        table.append((k, " ".join(mine)))
    asked = []
    own = module.likely
    monkeypatch.setattr(module, "likely", lambda pairs, *a: asked.append(pairs.count()) or own(pairs, *a))
    assert {r.doc_id: r.component_id for r in near_dedup(docs(spark, table)).collect()} == brute_components(sets_of(table), 85)
    assert sum(asked) < 25 * len(table), asked
