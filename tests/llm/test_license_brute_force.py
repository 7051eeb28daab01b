"""License confirmation against a plain edit distance over whole blocks, and the rank of overlapping notices."""

import random

from streakline.llm import license_scan as ls


def least_edits(want, have):
    """Fewest edits from ``want`` to any stretch of ``have``, with digits fixed: a full table, no band, no start places."""
    inf = 10 ** 9
    above = [0] * (len(have) + 1)
    for w in want:
        row = [inf if w[0].isdigit() else above[0] + 1]
        for p, h in enumerate(have):
            keep = above[p] if w == h else inf if w[0].isdigit() or h[0].isdigit() else above[p] + 1
            drop = inf if w[0].isdigit() else above[p + 1] + 1
            add = inf if h[0].isdigit() else row[p] + 1
            row.append(min(keep, drop, add))
        above = row
    return min(above)


def edited(rnd, want, edits):
    w = list(want)
    for _ in range(edits):
        p = rnd.randrange(len(w))
        if w[p][0].isdigit():
            continue
        how = rnd.choice("sid")
        if how == "s":
            w[p] = rnd.choice(["other", "of", "the", "2021"])
        elif how == "i":
            w.insert(p, rnd.choice(["of", "really"]))
        else:
            del w[p]
    return w


def test_confirmation_is_the_least_edit_distance():
    scanner, rnd = ls.Scanner(), random.Random(11)
    held = 0
    for i, (_, want) in enumerate(scanner.templates):
        most = int(ls.MAX_DIFFERENT * len(want))
        for _ in range(25):
            have = (["alpha", "beta"] * rnd.randint(0, 3) + edited(rnd, want, rnd.randint(0, most + 2))
                    + ["gamma"] * rnd.randint(0, 3))
            spots = {}
            for p, w in enumerate(have):
                spots.setdefault(w, []).append(p)
            found = [hit for at in scanner.offsets(i, spots) if (hit := scanner.confirm(i, have, at))]
            least = least_edits(want, have)
            assert bool(found) == (least <= most), (want, have)
            if found:
                held += 1
                assert min(f[0] for f in found) == least
                for different, first, last in found:
                    assert least_edits(want, have[first:last + 1]) <= different <= most
    assert held > 300


def test_edited_notice_within_the_bound_is_found():
    text = "The beta of notice and this permission notice shall be included in all copies or substantial portions of the Software."
    _, found, _ = ls.Scanner().scan(text)
    assert [(f[0], f[3]) for f in found] == [("MIT", 2)]


def test_saved_bytes_rank_overlapping_notices():
    """A long notice with a changed word wins against the short exact one that it contains."""
    long, short = "alpha license terms hold for every copy of this work and all parts of it without any limit", "every copy of this work"
    scanner = ls.Scanner([("short", short), ("long", long)])
    _, found, _ = scanner.scan(long.replace("without", "with"))
    assert [(f[0], f[3]) for f in found] == [("long", 1)]
    # about as many bytes saved: the wording decides
    scanner = ls.Scanner([("one", long), ("two", long.replace("parts", "bits"))])
    for text, name in ((long, "one"), (long.replace("parts", "bits"), "two")):
        assert [(f[0], f[3]) for f in scanner.scan(text)[1]] == [(name, 0)]
