"""Counting quotient filters: exact counters of pairs of numbers.

A pair of numbers below 2**width is permuted by an invertible mixing of its two halves (a Feistel network), so the result
is spread evenly whatever the pairs are, and the pair can be had back from it. The upper bits of the result name the shard,
the next ones the slot (quotient) within a filter; the rest is the remainder, kept whole. A filter is sorted by quotient
and remainder, so filters of one shard are merged like sorted lists.
"""

import numpy as np

ROUNDS = 4
_U = np.uint64


def _mask(bits):
    return _U((1 << bits) - 1)


def _mix(x, key):
    x = (x + _U(key)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def permute(left, right, width):
    """Invertible map of pairs of numbers below 2**width; width is 32 at most where one word is to hold the pair."""
    m = _mask(width)
    left, right = left.astype(_U), right.astype(_U)
    for k in range(ROUNDS):
        left, right = right, left ^ (_mix(right, 2 * k + 1) & m)
    return left, right


def restore(left, right, width):
    m = _mask(width)
    left, right = left.astype(_U), right.astype(_U)
    for k in reversed(range(ROUNDS)):
        left, right = right ^ (_mix(left, 2 * k + 1) & m), left
    return left, right


def ordered(left, right, width):
    """(order that sorts the pairs, whether each place of it begins a new pair); widths over 32 bits are sorted by both halves."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    if width <= 32:
        x = (left << _U(width)) | right
        order = np.argsort(x, kind="stable")  # sorted runs are merged
        x = x[order]
        return order, np.r_[True, x[1:] != x[:-1]]
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    return order, np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]


def sorted_counts(left, right, count, width):
    """(left, right, count) sorted by (left, right), equal pairs added up."""
    if not len(left):
        return left, right, count
    order, first = ordered(left, right, width)
    at = np.flatnonzero(first)
    return left[order[at]], right[order[at]], np.add.reduceat(count[order], at)


def _packed(x, size):
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(raw, n, size):
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(n, size)
    return out.view("<u8").ravel().astype(_U)


def encode(left, right, count, width, shard_bits):
    """Bytes of a filter of sorted permuted pairs of one shard.

    head: entries, slot bits; then entries of each slot, remainders in whole bytes, and counters: one byte, 255 and eight
    bytes at the end for those of 255 and more.
    """
    n = len(left)
    slot_bits = min(max(n.bit_length() - 1, 0), width - shard_bits)
    rest = width - shard_bits - slot_bits
    slot = (left >> _U(rest)) & _mask(slot_bits)
    held = np.bincount(slot.astype(np.int64), minlength=1 << slot_bits)
    small = np.minimum(count, 255)
    parts = [np.array([n, slot_bits, int(held.max(initial=0) > 255)], "<i8").tobytes()]
    parts.append(held.astype("<u4" if held.max(initial=0) > 255 else "u1").tobytes())
    parts.append(_packed(left & _mask(rest), -(-rest // 8)))
    parts.append(_packed(right, -(-width // 8)))
    parts.append(small.astype(np.uint8).tobytes())
    parts.append(count[count >= 255].astype("<i8").tobytes())
    return b"".join(parts)


def decode(raw, width, shard_bits, shard):
    """(left, right, count) of a filter, sorted."""
    n, slot_bits, wide = np.frombuffer(raw, "<i8", 3).tolist()
    rest, at = width - shard_bits - slot_bits, 24

    def take(size):
        nonlocal at
        at += size
        return raw[at - size : at]

    held = np.frombuffer(take((4 if wide else 1) << slot_bits), "<u4" if wide else "u1")
    slot = np.repeat(np.arange(1 << slot_bits, dtype=np.uint64), held)
    top = (_U(shard) << _U(width - shard_bits)) if shard_bits else _U(0)
    left = top | (slot << _U(rest)) | _unpacked(take(n * -(-rest // 8)), n, -(-rest // 8))
    right = _unpacked(take(n * -(-width // 8)), n, -(-width // 8))
    count = np.frombuffer(take(n), np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(raw[at:], "<i8")
    return left, right, count
