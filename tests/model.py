"""The request handlers applied one request at a time, to compare set-wise jobs against."""

from __future__ import annotations


class Handlers:
    """In-memory stores with the effect of each single request."""

    def __init__(self, shard_of) -> None:
        self.shard_of = shard_of
        self.slots: dict[tuple, tuple] = {}  # (shard, id) -> (entity, seq)
        self.edges: dict[str, int] = {}
        self.marks: list[tuple] = []
        self.outcomes: dict[int, int] = {}

    def ingest(self, seq, entity, name, n_triplets):
        self.slots[self.shard_of(entity), name] = (entity, seq)
        if n_triplets:
            self.marks = [m for m in self.marks if m[0] != entity]
            self.edges[entity] = self.edges.get(entity, 0) + n_triplets

    def unlearn(self, seq, entity):
        shard = self.shard_of(entity)
        owned = [k for k, v in self.slots.items() if k[0] == shard and v[0] == entity]
        if not owned and entity not in self.edges:
            self.outcomes[seq] = 404
            return
        for slot in owned:
            del self.slots[slot]
        self.edges.pop(entity, None)
        self.marks.append((entity, shard, seq))
        self.outcomes[seq] = 200

    def apply(self, log):
        for seq, op, entity, name, _, n_triplets in sorted(log):
            if op == "I":
                self.ingest(seq, entity, name, n_triplets)
            else:
                self.unlearn(seq, entity)
        return self


def random_log(rng, shard_of, size):
    """Few entities, few shared ids, many documents without triplets, gaps in seq."""
    log, seq = [], 0
    for _ in range(size):
        seq += rng.randrange(1, 4)
        entity = f"ent_{rng.randrange(5)}"
        if rng.random() < 0.35:
            log.append((seq, "U", entity, None, shard_of(entity), 0))
        else:
            name = f"doc_{rng.randrange(6)}"
            log.append((seq, "I", entity, name, shard_of(entity), rng.choice([0, 0, 1, 2])))
    return log
