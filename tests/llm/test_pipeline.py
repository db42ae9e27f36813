"""Every stage of corpus_pipeline.run() against plain Python, on a small folder with planted cases."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from kerbline.llm import byte_bpe

SECRET = re.compile(r"AKIA[A-Z0-9]{20,}|(?:password|token): [a-z0-9]{6,}")


def grams(words):
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def folder(spark, path):
    rng = random.Random(8)
    words = lambda n: [rng.choice("the of ending thand ouwh éclair with tion er and re sh river stone".split()) for _ in range(n)]
    say = lambda w: " ".join(w) + "."
    good, items = [words(80) for _ in range(120)], [words(n) for n in (20, 40, 51)]
    texts = [*map(say, good), *(f"### %%% {k} " * 40 for k in range(80))]
    junk = set(range(120, 200))
    for k in range(6):  # exact copies, and near ones with a word replaced, left out, added
        texts += [say(good[k]), say(good[k][:40] + ["new"] + good[k][41:]), say(good[k][:20] + good[k][21:]), say(["so", *good[k]])]
    for item in items:  # at start, middle and end, whole and with a word replaced
        for part in (item, item[:10] + ["other"] + item[11:]):
            texts += [say(part + words(60)), say(words(30) + part + words(30)), say(words(60) + part)]
    for mark in ("password: hunter2secret", "token: abcdef99", "AKIA" + "ABCDEFGHIJ" * 2):
        texts += [f"{mark} {say(words(60))}", f"{say(words(30))} {mark} {say(words(30))} {mark}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    for name, of, kinds in (
        ("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", [(i, int(i not in junk), 0) for i in range(200)], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"),
    ):
        spark.createDataFrame(of, kinds).write.parquet(f"{path}/{name}.parquet")
    return rows, junk, items


def test_stages(spark, tmp_path, monkeypatch):
    import tiktoken

    rows, junk, items = folder(spark, str(tmp_path))
    got, written = {}, corpus_pipeline.common.written

    def kept(docs, name):
        out = written(docs, name)
        if name in dict(corpus_pipeline.STAGES):
            got[name] = sorted(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(corpus_pipeline.common, "written", kept)
    tokens = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    left = [r for r in rows if r[0] not in junk]
    assert got["quality"] == left

    sets = {r[0]: set(grams(r[1].split())) for r in left}
    root = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while any(root[i] != root[j] for i, j in near):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    left = [r for r in left if root[r[0]] == r[0]]
    assert got["near_duplicates"] == left and len(left) < len(sets)

    def holds(text, item):
        w, want = text.split(), grams(item)
        for k in range(max(1, len(w) - len(item) + 1)):
            both = (have := grams(w[k : k + len(item)])) & want
            if 100 * both.total() >= 75 * (have | want).total():
                return True
        return False

    before, left = len(left), [r for r in left if not any(holds(r[1], item) for item in items)]
    assert got["decontamination"] == left and before - len(left) == 14  # not 20 words with one replaced, nor 40 where the full stop changes one more

    left = [(i, t := SECRET.sub("[SECRET]", text), a, b, len(t)) for i, text, a, b, _ in left]
    assert got["secrets"] == left and sum("[SECRET]" in r[1] for r in left) == 6

    ranks = byte_bpe.read_ranks(P.path(byte_bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tokens == [(i, len(x := enc.encode_ordinary(t)), sha(" ".join(map(str, x))), sha(t)) for i, t, *_ in left]
