"""Greedy tiling against its definition; verbatim, reordered and clean documents."""

import random

from bibspark.llm import decontaminate as dc


def plain_total(text, item, least):
    """Tokens under greedy tiles by looking for the longest free match again and again."""
    used_text, used_item, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while (t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n]
                       and not used_text[t + n] and not used_item[p + n]):
                    n += 1
                best = max(best, (n, -t, -p)) if n > best[0] else best
        n, t, p = best
        if n < least:
            return total
        total += n
        for k in range(n):
            used_text[-t + k] = used_item[-p + k] = True


def test_tiles_equal_the_definition():
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.randrange(7) for _ in range(rng.randrange(4, 26))]
        text = []
        for _ in range(4):
            start = rng.randrange(len(item))
            text += item[start : start + rng.randrange(2, 12)] + [rng.randrange(7)]
        found = dc.tiles(text, item, 3)
        assert all(text[t : t + n] == item[p : p + n] for t, p, n in found)
        assert len({t + k for t, _, n in found for k in range(n)}) == sum(n for *_, n in found)
        assert sum(n for *_, n in found) == plain_total(text, item, 3)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_documents(spark):
    words = ITEM.split()
    shuffled = " ".join(words[10:] + ["and", "so"] + words[:10])
    docs = [(1, f"Before it. {ITEM.upper()}! And after."), (2, "x " * 300 + shuffled + " y" * 300), (3, " ".join(words[:9])),
            (4, "wholly different words stand in this one here"), (5, " ".join(reversed(words))), (6, ITEM.replace(" ", ", ")),
            (7, "he said tiny item there"), (7, "nothing of it"), (None, ITEM), (8, None), (9, "")]
    items = [(0, ITEM), (1, "tiny item"), (2, None), (3, ""), (0, ITEM), (None, "wholly different words stand in this one here")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, seed int, item_id int, size int")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, row int")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(df.repartition(3), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (6, 0), (7, 1), (None, 0), (4, None)}
    assert got[(2, 0)].n_tiles == 2 and got[(2, 0)].coverage == 1.0
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    # of two rows with one id only the contaminated one goes
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "7", "8", "9"]
    assert dc.contaminated(df, bench.limit(0)).count() == 0 and dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_odd_documents(odd, nothing, spark):
    bench = spark.createDataFrame([(0, "The red fox ran over the long hill")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in dc.contaminated(odd, bench).collect()) == ["0", "6", "None"]
    assert dc.drop_contaminated(nothing, bench).count() == 0
