"""Seeds of many documents are looked up at once, with the results of one by one."""

import random

import pyarrow as pa

from plantlens.llm import decontaminate


def test_only_documents_with_a_seed_are_looked_at_one_by_one(monkeypatch):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [words(n) for n in (6, 9, 11, 12, 15, 23, 24, 60)]
    index = decontaminate.Index.of([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = [" ".join(words(r.randrange(80))) for _ in range(200)] + [None, "", "w1"]
    for x in items:
        k = len(x) // 2
        texts += [" ".join(words(9) + x + words(7)), " ".join(x), " ".join(x[:k]), " ".join(x[k:])]  # the last two are whole in a row of rows alone
    column = pa.array(texts)
    alone = [index.matches(t) for t in decontaminate._rows_terms(column)]
    looked, matches = [], decontaminate.Index.matches
    monkeypatch.setattr(decontaminate.Index, "matches", lambda self, t: looked.append(1) or matches(self, t))
    assert list(decontaminate._rows_matches(column, index)) == alone and sum(map(bool, alone)) >= 16
    assert len(looked) < 60 and len(texts) > 200
