"""The clustering kernel against a plain walk through its rules, on random windows."""

import math
import random

import numpy as np
import pytest

from strandworks.operators.clustering import Settings, dp_medians


def walk(haps, copies, s):
    """Clusters by the rules, with dictionaries and loops; a cluster is dropped when it has no copies."""
    m, total = len(haps[0]), sum(copies)
    limit, mac = math.ceil(s.lmbda * m), s.min_mac or math.ceil(total * s.min_freq)
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))

    def medians(z, active, old):
        new = dict(old)
        for k in active:
            mine = [i for i in range(len(haps)) if z[i] == k]
            n = sum(copies[i] for i in mine)
            if n:
                new[k] = tuple(int(sum(copies[i] for i in mine if haps[i][j]) > n // 2) for j in range(m))
        return new

    def assign(med, active):
        z, d = [], []
        for h in haps:
            best = min(active, key=lambda k: (dist(h, med[k]), -k))
            z.append(best)
            d.append(dist(h, med[best]))
        return z, d

    sizes = lambda z: {k: sum(c for c, x in zip(copies, z, strict=True) if x == k) for k in set(z)}
    z = [0] * len(haps)
    if len(haps) == 1:
        return z
    med, k, last = medians(z, [0], {}), 1, None
    for it in range(s.max_iterations):
        z, d = assign(med, [x for x in med if x == 0 and it == 0 or sizes(z).get(x)])
        far = max(range(len(haps)), key=lambda i: (d[i], copies[i], -i))
        if d[far] >= limit and k < s.max_clusters:
            z[far], med[k] = k, haps[far]
            k += 1
        if it and z == last and k > 1:
            break
        if k == 1:
            z[far], med[1] = 1, haps[far]
            k = 2
        last = list(z)
        med = medians(z, list(sizes(z)), med)
    active = set(sizes(z))
    if len(active) > 2:
        if s.prune and sum(n > 2 for n in sizes(z).values()) > 2:
            active = {x for x in active if sizes(z)[x] > 2}
        last = list(z)
        while len(active) > 2:
            med = medians(z, active, med)
            z, _ = assign(med, active)
            n = sizes(z)
            active &= set(n)
            if len(active) <= 2:
                break
            low = min(active, key=lambda x: (n[x], -x))
            if n[low] < mac:
                active.discard(low)
                if len(active) == 2:
                    z, _ = assign(med, active)
            elif z == last:
                break
            last = list(z)
    used = sorted(set(z))
    return [used.index(x) for x in z]


@pytest.mark.parametrize("seed", range(40))
def test_kernel_follows_the_rules(seed):
    r = random.Random(seed)
    m = r.choice([3, 6, 10])
    founders = [[r.randint(0, 1) for _ in range(m)] for _ in range(r.choice([1, 2, 4]))]
    seen: dict[tuple, int] = {}
    for _ in range(r.choice([4, 40, 120])):
        h = tuple(1 - x if r.random() < 0.08 else x for x in r.choice(founders))
        seen[h] = seen.get(h, 0) + 1
    haps = sorted(seen, key=lambda h: h[::-1])  # the order of the packed bits
    copies = [seen[h] for h in haps]
    s = Settings(m, r.choice([0.1, 0.3, 0.6]), min_mac=r.choice([1, 3, 8]), max_clusters=r.choice([2, 5, 256]), prune=r.random() < 0.3)
    z, med = dp_medians(np.array(haps), np.array(copies), s)
    assert list(z) == walk(haps, copies, s)
    assert len(med) == len(set(z)) <= s.max_clusters
