"""Policies that plans are made under, checked on the driver before any job runs."""

from __future__ import annotations

from dataclasses import dataclass, replace

HEADS, TAGS, REFS = "refs/heads/", "refs/tags/", "refs/"
ACTIONS = ("create", "update", "delete", "skip", "block", "warn")
KINDS = ("branch", "tag", "other")


class PolicyError(ValueError):
    """A policy or mapping that can't be followed."""


@dataclass(frozen=True)
class Mapping:
    """A rename of one source ref; full names on both sides, or short branch names on both."""

    source: str
    target: str

    def normalized(self, allow_other: bool) -> Mapping:
        source, target = self.source.strip(), self.target.strip()
        if not source or not target:
            raise PolicyError(f"mapping {self.source!r}:{self.target!r} needs both a source and a target")
        full = [x.startswith(REFS) for x in (source, target)]
        if not any(full):
            return Mapping(HEADS + source, HEADS + target)
        if not all(full):
            raise PolicyError(f"mapping {source!r} -> {target!r} mixes a full and a short ref name")
        kinds = [kind_of(source), kind_of(target)]
        if "other" in kinds and not allow_other:
            raise PolicyError(f"mapping {source!r} -> {target!r} leaves branches and tags; allow all refs for that")
        if kinds[0] != kinds[1]:
            raise PolicyError(f"mapping {source!r} ({kinds[0]}) -> {target!r} ({kinds[1]}) changes the kind of ref")
        return Mapping(source, target)


def kind_of(ref: str) -> str:
    for prefix, kind in ((HEADS, "branch"), (TAGS, "tag"), (REFS, "other")):
        if ref.startswith(prefix):
            return kind
    return ""


@dataclass(frozen=True)
class Policy:
    """Which refs take part, and what may happen to them."""

    branches: tuple[str, ...] = ()
    mappings: tuple[Mapping, ...] = ()
    include_tags: bool = False
    all_refs: bool = False
    force: bool = False
    prune: bool = False
    dry_run: bool = False
    exclude_prefixes: tuple[str, ...] = ()
    exclude_refs: tuple[str, ...] = ()

    def checked(self) -> Policy:
        """The policy with normalized mappings, and without a branch list under all_refs; raises on conflicts."""
        seen: dict[str, Mapping] = {}
        done = []
        for mapping in self.mappings:
            one = mapping.normalized(self.all_refs)
            if one.target in seen:
                raise PolicyError(f"target {one.target} is mapped from both {seen[one.target].source} and {mapping.source}")
            seen[one.target] = mapping
            done.append(one)
        return replace(self, mappings=tuple(done), branches=() if self.all_refs else self.branches)

    @property
    def wants_tags(self) -> bool:
        return self.include_tags or self.all_refs

    def scan_prefixes(self) -> list[str]:
        """Ref name prefixes that a scan of the source can be limited to."""
        if self.all_refs:
            return [REFS]
        found = set() if self.mappings else {HEADS}
        for mapping in self.mappings:
            source = mapping.source.strip()
            if source.startswith(TAGS):
                found.add(TAGS)
            elif source.startswith(HEADS) or not source.startswith(REFS):
                found.add(HEADS)
        return sorted(found | ({TAGS} if self.include_tags else set()))

