import random
from itertools import combinations

from fringeworks.llm import op02_license_scan as op

APACHE = op.TEMPLATES["apache-2.0-header"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def scan(make_docs, rows, **k):
    return {(r.doc_id, r.license): r for r in op.scan_licenses(make_docs(rows), **k).collect()}


def test_alignment_is_a_common_subsequence_and_whole_for_equal_texts():
    texts = ["a b c d e f a b", "a x c d y f b", "f e d c b a", "", "q q q q", "b c q q d e a"]
    for s, t in combinations(texts, 2):
        a, b = s.split(), t.split()
        p = op.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))
        assert len(p) <= lcs(a, b)
    assert len(op.align(texts[0].split(), texts[0].split())) == 8


def test_patience_by_hand():
    a, b = "x one q two q three y".split(), "one z two z three".split()
    assert [a[i] for i, _ in op.align(a, b)] == ["one", "two", "three"]


def test_finds_each_license_inside_prose_and_only_there(make_docs):
    prose = "the of and to in a thing that is by for under this or with at on be " * 30
    rows = [(i, prose + "\n" + t + "\n" + prose) for i, t in enumerate(op.TEMPLATES.values())] + [(100, prose), (101, None), (102, ""), (103, "licensed " * 50), (104, "version license apache the under licensed 2.0")]
    found = scan(make_docs, rows)
    for i, name in enumerate(op.TEMPLATES):
        assert found[i, name].coverage == 1.0, name
    assert not [k for k in found if k[0] >= 100]


def test_reworded_and_repeated(make_docs):
    words = APACHE.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 10)
    found = scan(make_docs, [(1, changed), (2, APACHE + "\n" + APACHE), (3, " ".join(words[: len(words) // 2])), (4, "Released under the MIT License. " * 3)])
    assert 0.8 <= found[1, "apache-2.0-header"].coverage < 1 and found[2, "apache-2.0-header"].coverage == 1
    assert (3, "apache-2.0-header") not in found and found[4, "mit"].coverage == 1


def test_long_text_and_empty_table(make_docs):
    assert scan(make_docs, [(1, "lorem " * 200_000 + op.TEMPLATES["mit"])])[1, "mit"].n_matched == 5
    assert scan(make_docs, []) == {}


def test_query_equals_a_plain_scan(spark, sf_dir):
    """Every row against a search for the normalised notice itself."""
    docs = [(r.doc_id, " ".join(op.words_of(r.text or ""))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    notice = {n: " ".join(op.words_of(t)) for n, t in op.TEMPLATES.items()}
    want = {(d, n) for d, t in docs for n, x in notice.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.license) for r in op.query(spark, sf_dir).where("coverage = 1").collect()}
    assert got == want and want


def test_words_far_apart_similar_notices_and_clashing_columns(make_docs, clash):
    words = APACHE.split()
    spaced = " ".join(w for i, x in enumerate(words) for w in (x, *(["lorem"] * 20 if i == 30 else [])))  # 20 words inserted in one place
    header = op.TEMPLATES["gpl-3.0-header"]
    rows = [(1, spaced), (2, header), (3, "x " * 700 + header + " y" * 700), (4, header + "\n" + op.TEMPLATES["agpl-3.0-header"])]
    out = {(r.doc_id, r.license): r.coverage for r in op.scan_licenses(make_docs(rows, clash)).collect()}
    assert out[1, "apache-2.0-header"] == 1.0
    for d in (2, 3):  # the notices of its family are told as the one that fits best
        assert {n for i, n in out if i == d} == {"gpl-3.0-header"} and out[d, "gpl-3.0-header"] == 1.0
    assert {n for i, n in out if i == 4} >= {"gpl-3.0-header", "agpl-3.0-header"}


def test_every_stretch_lies_whole_in_a_window():
    own = op.Scanner({"t": "a b c d e f g h i j"}, 0.8)
    t, count = own.templates["t"], own.count["t"]
    for before in range(0, 70, 3):
        words = (["a", "z"] * 50)[:before] + ["z"] * 3 + t[:5] + ["z"] * 20 + t[5:] + ["j"] * 9
        at = [i for i, w in enumerate(words) if w != "z"]
        start = before + 3
        assert any(a <= start and b >= start + 30 for a, b in own.windows(words, t, count)), (before, at)


def damaged(rnd, words, share):
    return [w for w in words if rnd.random() >= share]


def test_damaged_notices_keep_their_names():
    """A hundred texts a notice with 5 % of words missing: the notice is found whenever enough of it is left, and no other in its place."""
    rnd, own = random.Random(12), op.Scanner(op.TEMPLATES, op.COVERAGE)
    for name, t in own.templates.items():
        for _ in range(100):
            words = damaged(rnd, t, 0.05)
            found = {x[0]: x for x in own.scan(" ".join(words)) if x[6] is None}
            if len(words) < own.least(t):
                continue
            # another notice that resembles it may only be told where all that sets the two apart is gone
            rivals = [n for n, o in own.templates.items() if n != name and lcs(words, o) >= len(words) and len(o) <= len(t)]
            assert name in found or rivals, (name, words)
            assert set(found) - {name} <= set(rivals), (name, words, set(found))


def test_one_changed_word_does_not_change_the_license():
    own = op.Scanner(op.TEMPLATES, op.COVERAGE)
    got = {x[0]: (round(x[1], 2), x[6]) for x in own.scan(op.TEMPLATES["bsd-3-clause"].replace("endorse", "indorse"))}
    assert got == {"bsd-3-clause": (0.99, None), "bsd-2-clause": (1.0, "bsd-3-clause")}


def test_three_in_a_row_are_found_whenever_one_is():
    rnd, own, told, there = random.Random(13), op.Scanner(op.TEMPLATES, op.COVERAGE), 0, 0
    for name, t in own.templates.items():
        for _ in range(40):
            copies = [damaged(rnd, t, 0.12) for _ in range(3)]
            alone = [any(x[0] == name for x in own.scan(" ".join(c))) for c in copies]
            if not all(alone):
                continue
            found = [x for x in own.scan(" ".join(w for c in copies for w in c)) if x[0] == name]
            assert found, (name, copies)
            told, there = told + len(found), there + 3
    assert told >= 0.95 * there  # 1375 of 1422: a copy that is barely enough may lose words to its neighbour


def test_every_occurrence_is_a_row(make_docs):
    text = "\n some words between \n".join([APACHE] * 4)
    rows = sorted(r.first_word for r in op.scan_licenses(make_docs([(1, text)])).where("license = 'apache-2.0-header'").collect())
    assert len(rows) == 4 and len({b - a for a, b in zip(rows, rows[1:], strict=False)}) == 1
