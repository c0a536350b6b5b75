"""The planners' rules as a plain loop over one small network, for the tests."""
import heapq
import math
from collections import namedtuple
from hashlib import md5

Walk = namedtuple("Walk", "contigs nodes at distinct overlap")


def uniform(*parts):
    return (int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


class Loop:
    def __init__(self, edges, rules):
        self.rules, self.arcs = rules, [(x, y, c, float(m)) for c, a, b, m in edges for x, y in sorted({(a, b), (b, a)})]
        self.degree = {}
        for x, *_ in self.arcs:
            self.degree[x] = self.degree.get(x, 0) + 1

    def start(self, node):
        return Walk((), (node,), node, 0.0, 0.0)

    def fits(self, w, contig, metres, more=0.0):
        n = w.contigs.count(contig)
        return n == 0 or (n == 1 and metres <= self.rules.short and w.overlap + more + metres <= self.rules.budget)

    def ahead(self, w):
        """Least (repeated, total, order, contigs, nodes) to each node, and the unused metres on the way."""
        best, todo, fresh, k = {}, [(0.0, 0.0, 0, (), (w.at,))], {}, 0
        while todo:
            more, length, _, path, nodes = heapq.heappop(todo)
            if nodes[-1] in best:
                continue
            best[nodes[-1]] = (more, length, path, nodes)
            for x, y, c, m in self.arcs:
                if x == nodes[-1] and self.fits(w, c, m, more):
                    if c not in w.contigs:
                        fresh[c] = m
                    k += 1
                    heapq.heappush(todo, (more + m * (c in w.contigs), length + m, k, (*path, c), (*nodes, y)))
        return best, sum(fresh.values())

    def step(self, w, c, to, m):
        again = c in w.contigs
        return Walk((*w.contigs, c), (*w.nodes, to), to, w.distinct + m * (not again), w.overlap + m * again)

    def options(self, w, goal):
        """(walk after the move, worth of the move)."""
        r, out = self.rules, []
        for x, to, c, m in self.arcs:
            if x != w.at or not self.fits(w, c, m) or (w.contigs and w.contigs[-1] == c and to != w.at):
                continue
            after = self.step(w, c, to, m)
            best, unused = self.ahead(after)
            if goal not in best:
                continue
            score = m + r.ahead_weight * unused - r.way_weight * best[goal][1] - r.repeat_penalty * m * (c in w.contigs)
            score -= r.early_penalty * (to == goal and unused > r.finish_slack) + r.dead_end_penalty * (self.degree.get(to, 0) <= 1 and to != goal)
            out.append((after, score))
        return [o for o in out if o[0].at != goal] or out

    def connected(self, w, goal):
        best, _ = self.ahead(w)
        if goal not in best:
            return w
        more, length, path, nodes = best[goal]
        return Walk((*w.contigs, *path), (*w.nodes, *nodes[1:]), goal, w.distinct + length - more, w.overlap + more)

    def worth(self, w, goal):
        best, unused = self.ahead(w)
        score = w.distinct - 10 * w.overlap + 0.01 * unused
        return score + (250 if w.at == goal else -0.05 * best[goal][1] if goal in best else -500)

    def drawn(self, options, key, top, n, salt):
        few = sorted(options, key=lambda o: (-o[1], o[0].contigs, o[0].at))[:top]
        weight = lambda p, o: math.log(uniform(*key, ",".join(map(str, o[0].contigs)), o[0].at, salt)) / (len(few) - p)
        return [o for _, o in sorted(enumerate(few), key=lambda x: (-weight(*x), x[1][0].contigs))][:n]

    def tried(self, w, goal, key, top, salt):
        while len(w.contigs) < self.rules.steps:
            _, unused = self.ahead(w)
            if w.at == goal and w.contigs and unused <= self.rules.stop_slack and uniform(*key, ",".join(map(str, w.contigs)), salt, "end") < self.rules.stop_chance:
                break
            options = self.options(w, goal)
            if not options:
                break
            w = self.drawn(options, key, top, 1, salt)[0][0]
        return self.connected(w, goal)

    def order(self, w, goal, walk):
        return (w.at != goal, -w.distinct, w.overlap, -self.worth(w, goal), len(w.contigs), w.contigs, walk)
