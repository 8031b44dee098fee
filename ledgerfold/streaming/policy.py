"""The settings of a drain loop, and what they must satisfy."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


#: Settings that are read anew for each decision; the others stay as they were at the start.
LIVE = ("mutations", "bytes", "age", "max_entries", "max_bytes")


@dataclass(frozen=True)
class Policy:
    """Triggers of a drain, bounds of a shard's tail, cadence of trims; then what is fixed
    when the loop starts. Bytes are encoded bytes, times seconds."""

    mutations: int = 256
    bytes: int = 256 << 10
    age: float = 5.0
    max_entries: int = 8192
    max_bytes: int = 8 << 20
    max_shards: int = 256
    tail_budget: int = 2 << 30
    trim_drains: int = 16
    trim_age: float = 60.0

    def __post_init__(self) -> None:
        low = [f.name for f in fields(self) if getattr(self, f.name) <= 0]
        if low:
            raise ValueError(f"not positive: {', '.join(low)}")
        if self.max_bytes > self.tail_budget // self.max_shards:  # as a quotient, so that no product overflows
            raise ValueError(f"{self.max_bytes} bytes for each of {self.max_shards} shards exceed the budget of {self.tail_budget}")

    def now(self, **settings) -> Policy:
        """The policy with live settings changed; others can't be."""
        if fixed := sorted(set(settings) - set(LIVE)):
            raise ValueError(f"fixed at the start: {', '.join(fixed)}")
        return replace(self, **settings)


def trims(times: list[float], policy: Policy = Policy()) -> list[int]:
    """After which drains (numbers from 0, by their times) a trim runs: when so many drains
    or so much time have passed since the last one; the first counts from the first drain."""
    out, last, since = [], -1, None
    for i, t in enumerate(times):
        since = t if since is None else since
        if i - last >= policy.trim_drains or t - since >= policy.trim_age:
            out.append(i)
            last, since = i, t
    return out
