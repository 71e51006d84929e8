"""Plain models of segmentation and feature extraction, chunk by chunk."""

import hashlib


def stream(n):
    return [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(n)]


def mark(fp, span):
    return int.from_bytes(bytes.fromhex(fp)[:4], "little") % span == 0


def segments(fps, expected):
    out, begin = [], 0
    for i, fp in enumerate(fps):
        size = i - begin + 1
        if size == expected * 2 or (size >= expected // 2 and mark(fp, expected // 2)):
            out.append((begin, i))
            begin = i + 1
    if begin < len(fps):
        out.append((begin, len(fps) - 1))
    return out


def features(fps, method, count, expected):
    n = len(fps)
    if method == "first":
        return fps[:1]
    if n <= count:
        return list(fps)
    if method == "finesse":
        width = n // count
        return [min(fps[j * width : (j + 1) * width if j < count - 1 else n]) for j in range(count)]
    if method == "mink":
        return sorted(fps)[:count]
    if method == "ntrans":
        from stratadup.functions.fingerprints import MULTIPLIERS, OFFSETS, SPAN

        value = lambda fp, j: (MULTIPLIERS[j] * int.from_bytes(bytes.fromhex(fp), "little") + OFFSETS[j]) % SPAN
        return [max(fps, key=lambda fp, j=j: value(fp, j)) for j in range(count)]
    parts = [[fps[0]]]
    for fp in fps[1:]:
        if mark(fp, expected // count) and len(parts) < expected // 2:
            parts.append([])
        parts[-1].append(fp)
    least = [min(p) for p in parts]
    return sorted(least)[:count] if len(least) > count else least
