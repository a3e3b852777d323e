import random
from statistics import median

from markgrid.operators import bands


def by_hand(profile, rows, y0, y1, gap, apart, reach, share, least):
    """The same rule in plain loops over a dense profile {y: v}."""
    dark = [y for y in sorted(profile) if profile[y] >= least and profile[y] >= share * sum(profile.get(y + k, 0) for k in range(-reach, reach + 1)) / (2 * reach + 1)]
    found = []
    for y in dark:
        if found and y == found[-1][1] + 1:
            found[-1][1] = y
        else:
            found.append([y, y])
    merged = []
    for b in found:
        if merged and b[0] - merged[-1][1] <= gap:
            merged[-1][1] = b[1]
        else:
            merged.append(list(b))
    kept = []
    for b in merged:
        if not kept or sum(b) // 2 - sum(kept[-1]) // 2 >= apart:
            kept.append(b)
        elif b[1] - b[0] > kept[-1][1] - kept[-1][0]:
            kept[-1] = b
    if len(kept) > rows:
        top = sorted(sorted(kept, key=lambda b: (b[0] - b[1], b[0]))[:rows])
        return "trim", [sum(b) // 2 for b in top]
    centres = [sum(b) // 2 for b in kept]
    if len(kept) == rows:
        return "exact", centres
    if len(kept) >= 3:
        steps = [b - a for a, b in zip(centres, centres[1:])]
        most = int(int(median(steps)) * 1.5)
        pitch = int(median([s for s in steps if s <= most]))
        return "extrapolated", centres + [centres[-1] + k * pitch for k in range(1, rows - len(centres) + 1)]
    return "fallback", [round(y0 + (i + 0.5) * ((y1 - y0) / rows)) for i in range(rows)]


def test_rows_of_profiles(spark):
    r, profiles = random.Random(4), {}
    for page in range(60):
        own = {}
        for k in range(r.randrange(0, 14)):
            y = 100 + 60 * k + r.randrange(-8, 9)
            if r.random() < 0.9:
                own |= {y + i: r.randrange(20, 40) for i in range(r.randrange(2, 9))}
        own |= {r.randrange(50, 950): r.randrange(0, 4) for _ in range(30)} | {960: 0}
        profiles[page] = own
    df = spark.createDataFrame([(p, y, v) for p, own in profiles.items() for y, v in own.items()], "page int, y int, v int")
    seen = set()
    for gap, apart in ((2, 20), (9, 50)):
        got = {}
        for x in bands.rows_of_profile(df, "page", 8, 100, 900, gap, apart, 15, 0.5, 5).collect():
            got.setdefault(x.page, {})[x.row_idx] = (x.how, x.y)
        for page, own in profiles.items():
            how, ys = by_hand(own, 8, 100, 900, gap, apart, 15, 0.5, 5)
            assert got[page] == {i: (how, y) for i, y in enumerate(ys)}
            seen.add(how)
    assert seen == {"exact", "trim", "extrapolated", "fallback"}
    assert bands.rows_of_profile(df.limit(0), "page", 8, 100, 900, 2, 20).count() == 0


def test_planted_shifts_are_found(spark):
    expected = [100, 160, 220, 300]
    rows, want = [], {}
    for page, shift in enumerate([-12, -3, 0, 5, 12]):
        rows += [(page, y + shift, 9) for y in expected] + [(page, y + shift + 1, 4) for y in expected] + [(page, 20, 50)]
        want[page] = (shift, 36)
    rows += [(10, y + s, 7) for y in expected for s in (-4, 6)] + [(11, 5, 3)] + [(12, y, 0) for y in expected] + [(13, 100, 5), (13, 160 + 2, 5)]
    want |= {10: (-4, 28), 11: (-12, 0), 12: (0, 0), 13: (0, 5)}
    df = spark.createDataFrame(rows, "page int, y int, v int")
    got = {x.page: (x.shift, x.score) for x in bands.profile_shift(df, spark.createDataFrame([(y,) for y in expected], "y int"), "page", 12).collect()}
    assert got == want
    assert bands.profile_shift(df.limit(0), spark.createDataFrame([(5,)], "y int"), "page", 12).count() == 0
