"""Processing tasks: what a proposer is asked to make of canonical blocks, as documents that name their sources."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestone.exceptions import MembershipError
from lodestone.operators import validate as gate
from lodestone.sources.files import canonical_json


@dataclass(frozen=True)
class Task:
    task_id: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    instructions: str
    rederives: str | None = None


def define(store, sources: tuple[str, ...], targets: tuple[str, ...], instructions: str, rederives: str | None = None) -> Task:
    """Only proposable modules can be targets, and every source must be a canonical block of the head."""
    if bad := [t for t in targets if t not in gate.PROPOSABLE]:
        raise ValueError(f"nothing is proposed to {', '.join(bad)}")
    held = store.composition().where("memory_type = 'canonical'")
    missing = store._ids(list(sources)).join(held, "block_id", "left_anti").count()
    if missing:
        raise MembershipError(f"{missing} of the sources are not held")
    document = {"sources": sorted(sources), "targets": sorted(targets), "instructions": instructions}
    document |= {"rederives": rederives} if rederives else {}
    name = "sha256:" + hashlib.sha256(canonical_json(document)).hexdigest()
    return Task(name, tuple(sorted(sources)), tuple(sorted(targets)), instructions, rederives)


def define_rederivation(store, block_id: str, instructions: str) -> Task:
    """The task that makes a derived block anew from the sources that its last derivation cites."""
    from lodestone.operators import ledger

    row = ledger.derivations(store.records()).where(f"block_id = '{block_id}'").select("derived_from").first()
    kind = store.composition().where(f"block_id = '{block_id}'").select("memory_type").first()
    if row is None or kind is None:
        raise MembershipError(f"{block_id} is not held, or nothing says what it was derived from")
    return define(store, tuple(row.derived_from), (kind.memory_type,), instructions, block_id)


def sources_of(store, task: Task) -> DataFrame:
    """The task's sources as decoded blocks, for a proposer."""
    from lodestone.plans import blocks as bl

    return bl.decoded(store.blocks().where("memory_type = 'canonical'").join(store._ids(list(task.sources)), "block_id", "left_semi"))
