"""Parts that need no Spark, held to brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import bagminhash as G, brown, collision, mixing, multiindex, packing, sharding, toxicity, warc


@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_flow_moves_the_fewest_bytes(supply, shards):
    cap = sharding.near_equal(sum(supply), shards)
    flow = sharding.min_cost_flow(dict(enumerate(supply)), cap)
    for i, s in enumerate(supply):
        assert sum(f for (o, _), f in flow.items() if o == i) == s
    for j, c in cap.items():
        assert sum(f for (_, t), f in flow.items() if t == j) <= c
    assert sum(f for (i, j), f in flow.items() if i == j) == sum(min(s, cap.get(i, 0)) for i, s in enumerate(supply))


def test_flow_with_a_cost_matrix():
    cost = {(0, 0): 5, (0, 1): 1, (1, 0): 2, (1, 1): 4}
    supply, cap = {0: 3, 1: 3}, {0: 3, 1: 3}
    flow = sharding.min_cost_flow(supply, cap, lambda i, j: cost[i, j])
    best = min(5 * a + 1 * (3 - a) + 2 * (3 - a) + 4 * a for a in range(4))
    assert sum(cost[k] * f for k, f in flow.items()) == best


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_subset_sums_are_as_near_as_can_be(items, budget):
    sizes, counts = np.array([x for x, _ in items]), np.array([n for _, n in items])
    take = mixing.fit_counts(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and (take * sizes).sum() <= budget
    best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := int((np.array(c) * sizes).sum())) <= budget)
    assert best - (take * sizes).sum() <= sizes.max()  # the even share is fixed before the programme fits the rest
    if budget < sizes.min() + 1 or budget >= (sizes * counts).sum():
        assert (take * sizes).sum() == best


def test_large_budgets_fit_exactly():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 3000)
    counts = rng.integers(1, 40, len(sizes))
    for budget in (12_345_678, 999_999, 5):
        assert (mixing.fit_counts(sizes, counts, budget) * sizes).sum() == budget


def laid_out(runs):
    used, count = defaultdict(list), Counter()
    for length, rank, n, seq, offset in runs:
        count[length] += n
        for i in range(n):
            used[seq + i].append((offset, length))
    return used, count


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_plans_are_sound(lengths):
    hist = Counter(lengths)
    runs = packing.plan_runs(hist, 64, groups=6)
    used, count = laid_out(runs)
    assert count == hist
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    ranks = defaultdict(list)
    for length, rank, n, _, _ in runs:
        ranks[length] += range(rank, rank + n)
    assert all(sorted(v) == list(range(hist[k])) for k, v in ranks.items())
    assert len(used) <= 1.3 * -(-sum(lengths) // 64) + 8 or sum(x > 32 for x in lengths) >= len(used) - 8


def test_packing_is_tight():
    random.seed(3)
    lengths = [min(2048, int(random.lognormvariate(6.4, 1)) + 1) for _ in range(20_000)]
    used, _ = laid_out(packing.plan_runs(Counter(lengths), 2048, groups=40))
    assert len(used) <= 1.02 * sum(lengths) / 2048


def test_fragments_equal_the_tokenizer():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = packing.FragmentIds(*packing.default_tokenizer())
    for text in ("", " ", "  a  b", "a b", "x\n y", "x \n\n y ", "\t\ta", "don't stop, é 日本語 ok", "a b c", "end.  ", "\n", "1 2 3!! ?", "a  b", "<|endoftext|> x"):
        assert np.frombuffer(own.text_ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_special_strings_equal_the_tokenizer():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    own = packing.FragmentIds(*packing.default_tokenizer())
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", " \n<|endoftext|>  x  y ", "<|endoftext|", "<|ENDOFTEXT|>", "<<|endoftext|>>", "plain  text"):
        assert np.frombuffer(own.with_specials(text, packing.SPECIALS), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=7))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b") == "com,example)/a?b"
    assert warc.url_key("https://a.b.org/") == "org,b,a)/" and warc.url_key("") == ""


def test_signatures_estimate_weighted_jaccard():
    rng, errors = np.random.default_rng(5), []
    for k in range(40):
        base = rng.integers(1, 2**63, 300).astype(np.uint64)
        a = np.repeat(base[:250], rng.integers(1, 6, 250))
        b = np.repeat(base[40:], rng.integers(1, 6, 260))
        s = G.signatures([a, b], 512)
        errors.append((s[0] == s[1]).mean() - G.similarity(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    one, two = G.signatures([a], 64), G.signatures([b, a], 64)
    assert (one[0] == two[1]).all()  # a signature does not depend on its neighbours


def test_similarity_is_of_multisets():
    a, b = np.array([1, 1, 2, 3], np.uint64), np.array([1, 2, 2, 4], np.uint64)
    assert G.similarity(a, b) == 2 / 6 and G.similarity(a, a) == 1.0 and G.similarity(a, b[:0]) == 0.0


def test_least_count_loses_a_millionth():
    rng, p = np.random.default_rng(0), 0.9545
    t = collision.least_count()
    assert 15 < t < 32 and (rng.binomial(32, p, 200_000) >= t).mean() > 0.9999


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(2)
    a, b = rng.random(5), rng.random(6)
    cells = list(multiindex.walk(a, b, np.ones((5, 6), int), 30))
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)
    assert len(list(multiindex.walk(a, b, np.ones((5, 6), int), 7))) == 7


def test_ftrl_learns_and_stays_sparse():
    rng, model = np.random.default_rng(1), toxicity.Ftrl(bits=10, l1=1.0)
    for _ in range(3000):
        at = np.unique(rng.integers(2, 1024, 20))
        y = int(rng.random() < 0.3)
        at = np.unique(np.append(at, y))  # coordinate 1 marks label 1
        model.learn(at, np.ones(len(at)), y)
    w = model.weights(model.z, model.n)
    assert w[1] > 1 and w[0] < 0 and (w != 0).mean() < 0.5


def test_exchange_counts_once():
    cls = np.array([0, 1, 0])
    ids = brown._corpus([np.array([0, 1], np.int32).tobytes(), b"", np.array([-2], np.int32).tobytes()])
    end = brown.CLASSES + brown.FORMS
    assert brown._classes_of(ids, cls).tolist() == [end, 0, 1, end, end, brown.CLASSES + 1, end]


@pytest.mark.parametrize("word,kind", [(b"abc", 0), (b"abc,", 1), ("é".encode(), 2), ("é.".encode(), 3), (b"x9", 0)])
def test_word_forms(word, kind):
    assert brown.form(word) == kind
