"""Parameters of gene calling."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


def start_weights(text: str) -> dict[str, Decimal]:
    """'atg:0.85,gtg:0.10' to weights relative to the largest."""
    pairs = (item.split(":") for item in text.split(","))
    weights = {codon.lower(): Decimal(weight) for codon, weight in pairs}
    most = max(weights.values())
    return {codon: weight / most for codon, weight in weights.items()}


def stop_codons(text: str) -> tuple[str, ...]:
    return tuple(codon.lower() for codon in text.split(","))


#: Codes by which the command-line names of formats are known; fasta is another name of fna.
FORMATS = ("tabular", "genbank", "gff", "gff3", "fna", "faa")
ALIASES = {"fasta": "fna"}


def output_format(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"{name} is none of {', '.join(FORMATS)}")
    return name


@dataclass(frozen=True)
class Params:
    starts: dict[str, Decimal] = field(default_factory=lambda: start_weights("atg:0.85,gtg:0.10,ttg:0.05"))
    stops: tuple[str, ...] = stop_codons("tag,tga,taa")
    #: shortest ORF, its stop codon included
    min_length: int = 90
    #: bases of a GC window, over all three phases
    gc_window: int = 120
    #: nodes further apart aren't connected
    reach: int = 500
    #: nodes further from a contig's end aren't connected to it
    end_reach: int = 2000
    #: a longer gap costs by its length
    linear_gap: int = 300
    #: switching strands costs 1 over this
    strand_chance: float = 0.05


DEFAULT = Params()
