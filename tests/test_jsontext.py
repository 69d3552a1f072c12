import json
import random

from tarnwork.functions import jsontext

DEEP = "[" * 200_000 + "]" * 200_000


def some(r, depth):
    c = r.random()
    if depth <= 0 or c < 0.4:
        return r.choice([1, -2.5, 'a"bé\n', True, None, 1e300, "", " {", 12345678901234567890])
    if c < 0.7:
        return [some(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {r.choice('abc"') + str(i): some(r, depth - 1) for i in range(r.randint(0, 4))}


def reads(f, text):
    try:
        f(text)
    except ValueError:
        return False
    return True


def test_reads_and_writes_like_the_standard_library():
    r = random.Random(1)
    for _ in range(500):
        v = some(r, 5)
        t = json.dumps(v, indent=r.choice([None, 1]))
        assert jsontext.deep_read(t) == v
        assert jsontext.dump(v, sort_keys=True, scalar=lambda _: None) == json.dumps(v, sort_keys=True, ensure_ascii=False)
        k = r.randrange(len(t) + 1)
        bad = t[:k] + r.choice(["", "}", "]", ",", ":", "x"]) + t[k + 1 :]
        assert reads(json.loads, bad) == reads(jsontext.deep_read, bad), bad


def test_any_depth():
    v = jsontext.parse(DEEP)
    assert jsontext.dump(v) == DEEP
    assert jsontext.parse(DEEP[:-1]) is None and jsontext.parse(None) is None and jsontext.parse("{") is None
