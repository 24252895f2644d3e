"""Every token stays in the window that the sum-of-squares rule chose for it."""

import numpy as np
import pytest

from scarpline.llm import packing


@pytest.mark.parametrize("documents", [300, 1600, 10_000])
def test_tokens_stay_where_the_rule_put_them(documents):
    generator = np.random.default_rng(documents)
    packer = packing.Packer()
    home, windows, place = {}, {}, packer._place

    def watched(piece):
        place(piece)
        for filled in packer.stacks.values():  # which open window holds the piece now
            for pieces in filled[-1:]:
                if any(p is piece for p in pieces):
                    windows[id(pieces)] = pieces
                    home[piece[0]] = id(pieces)

    packer._place = watched
    sizes = np.minimum(generator.lognormal(5.5, 1.2, documents).astype(int) + 1, 20_000)
    for i, size in enumerate(sizes):
        packer.add(i, np.full(size, i, dtype=np.uint32))
    still_open = {id(pieces): {p[0] for p in pieces} for stack in packer.stacks.values() for pieces in stack}
    closed = packer.next
    packer.finish()
    sequences = {}
    for doc_id, start, length, _, total, sequence, offset in packer.done:
        sequences.setdefault(sequence, []).append((offset, length, doc_id, total))
    assert sum(length for pieces in sequences.values() for _, length, _, _ in pieces) == sizes.sum()
    groups = list(still_open.values())
    for number, pieces in sequences.items():
        total = sum(p[1] for p in pieces)
        assert total == packing.WINDOW or total & (total - 1) == 0
        if number >= closed:  # from a window left open: all of its pieces were neighbours there
            assert any({p[2] for p in pieces} <= group for group in groups)
    cut = {}
    for pieces in sequences.values():
        for _, length, doc_id, total in pieces:
            cut[doc_id] = cut.get(doc_id, 0) + 1
    whole = [i for i, size in enumerate(sizes) if size < packing.WINDOW and not any(i in g for g in groups)]
    assert all(cut[i] == 1 for i in whole)
    assert packer.open == 0 and not any(packer.stacks.values()) and not packer.level[:packing.WINDOW].any()


def test_too_many_windows_close_as_they_stand():
    packer = packing.Packer(window=64, max_open=4)
    for i in range(50):
        packer.add(i, np.full(40, i, dtype=np.uint32))  # no two fit together
        assert packer.open <= 4
    packer.finish()
    lengths = [r[2] for r in packer.done]
    assert sum(lengths) == 2000 and set(lengths) == {32, 8}
