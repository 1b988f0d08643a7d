"""Every diagonal on which half of an item agrees is found, whatever tokens agree and wherever the item stands."""

import random

from inkwell.llm import op6_decontaminate


def test_any_half_of_any_item_is_found(spark):
    rng = random.Random(31)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(n)]
    items = {n: fresh(n) for n in [4, 5, 6, 7, 8, 9, 10, 13, 16, 25, 40]}
    rows, want, number = [], set(), 0
    for n, item in items.items():
        halves = [set(range(0, n, 2)), set(range(n // 2, n)), set(range(-(-n // 2)))]
        halves += [set(rng.sample(range(n), -(-n // 2))) for _ in range(12)]
        for half in halves:
            agreeing = [w if j in half else fresh(1)[0] for j, w in enumerate(item)]
            enough = 2 * len(half) >= n
            rows.append((number, " ".join(fresh(rng.randrange(7)) + agreeing + fresh(rng.randrange(5)))))
            want |= {(number, n)} if enough else set()
            number += 1
            short = [w if j in set(list(half)[: max(0, n // 2 - 1)]) else fresh(1)[0] for j, w in enumerate(item)]
            rows.append((number, " ".join(short) if n < 13 else ""))  # less than half, no window
            number += 1
    rows += [rows[0], (number, None), (number + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    frame = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op6_decontaminate.leaks(docs, frame)[1].collect()}
    assert want <= found
    assert all(d % 2 == 0 for d, _ in found)
