import numpy as np

from urlintel.llm.hashing import ALNUM, VISIBLE, words


def thue_morse(n, a, b):
    x = np.zeros(1, bool)
    while len(x) < n:
        x = np.concatenate([x, ~x])
    return bytes(np.where(x, b[0], a[0]).astype(np.uint8))


def test_regular_words_do_not_collide():
    """Such words have equal polynomial hashes modulo 2^64, whatever the base."""
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n, b"a", b"b"), thue_morse(n, b"b", b"a")
        for kind in (VISIBLE, ALNUM):
            h = words(x + b" " + y + b" " + x.upper(), kind)
            assert h[0] != h[1] and h[0] == h[2]


def test_words_do_not_depend_on_their_place():
    rest = b"x" * 700
    h = words(b"one " + rest + b" two " + rest + b" one", VISIBLE)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
