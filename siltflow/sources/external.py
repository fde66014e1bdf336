"""Thin wrappers of external programs; the engine has native forms of what they do."""

from __future__ import annotations

import shutil
import subprocess

CHIMERA_MODES = ("uchime_denovo", "uchime2_denovo", "uchime3_denovo", "uchime_ref")
CLUSTER_MODES = ("cluster_fast", "cluster_size", "cluster_smallmem", "cluster_unoise")


def find(command: str, path: str | None = None) -> str:
    """Full path of a program, or an error that names it."""
    found = shutil.which(command, path=path) or shutil.which(command)
    if not found:
        raise FileNotFoundError(f"{command} is not installed")
    return found


def run(command: str, args: list[str], path: str | None = None) -> str:
    """Standard output of a program; a failure raises with its message."""
    done = subprocess.run([find(command, path), *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{command} failed: {done.stderr[-500:]}")
    return done.stdout


def chimera_args(fasta: str, out: str, mode: str = "uchime_denovo", output_mode: str = "nonchimeras", ref: str | None = None, threads: int = 1) -> list[str]:
    if mode not in CHIMERA_MODES:
        raise ValueError(f"mode must be one of {CHIMERA_MODES}")
    if mode == "uchime_ref" and not ref:
        raise ValueError("uchime_ref needs a reference")
    return [f"--{mode}", fasta, f"--{output_mode}", out, "--threads", str(threads), *(["--db", ref] if ref else [])]


def cluster_args(fasta: str, out: str, identity: float = 0.97, mode: str = "cluster_fast", threads: int = 1) -> list[str]:
    if mode not in CLUSTER_MODES:
        raise ValueError(f"mode must be one of {CLUSTER_MODES}")
    return [f"--{mode}", fasta, "--centroids", f"{out}.fas", "--uc", f"{out}.uc", "--id", str(identity), "--threads", str(threads)]


def search_args(query: str, out: str, database: str, max_target_seqs: int = 10, perc_identity: float = 90, qcov: float = 90, threads: int = 1) -> list[str]:
    return ["-query", query, "-out", out, "-db", database, "-outfmt", "6 std qcovs staxids", "-max_target_seqs", str(max_target_seqs), "-perc_identity", str(perc_identity), "-qcov_hsp_perc", str(qcov), "-num_threads", str(threads)]
