"""How many archives one machine reads at once, for runs without a cluster."""

from __future__ import annotations

import os
import warnings

JOB_BYTES = 512 << 20  # a reader's Python worker with its largest usual record, and its share of the JVM


def core_count() -> int:
    """Cores that this process may use; 1 if that cannot be told."""
    return os.process_cpu_count() or 1


def available_memory(path: str = "/proc/meminfo") -> int | None:
    """Bytes that can be had without swapping, as Linux tells; None elsewhere."""
    try:
        with open(path, encoding="ascii") as f:
            found = next((line.split() for line in f if line.startswith("MemAvailable:")), None)
    except OSError:
        return None
    return int(found[1]) * 1024 if found else None


def local_jobs(asked: int | None = None, memory: int | None = None) -> int:
    """Jobs for this machine: ``asked``, or one a core; at most two a core and what ``memory`` holds, with a warning."""
    cores = core_count()
    jobs = cores if asked is None else max(1, asked)
    for most, why in ((2 * cores, f"{cores} cores"), (max(1, memory // JOB_BYTES) if memory else jobs, f"{(memory or 0) / 1e9:.1f} GB of memory")):
        if jobs > most:
            warnings.warn(f"{jobs} jobs are too many for {why}; {most} run", stacklevel=2)
            jobs = most
    return jobs
