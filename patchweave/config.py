"""Settings of a plan build, and the fingerprint under which its results are frozen."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

#: Versions that enter identities.
SCHEMA_VERSION, ACQUISITION_VERSION, BUILDER_VERSION = 1, "acq-v1", "builder-v1"
POLICY_VERSION, TOKENIZER_VERSION = "heuristic-v1", "chars-div-4-v1"
SENSITIVE_PATTERNS = (".env*", "*.pem", "*.key", "*.p12", "*.jks", "credentials*", "secrets*")


@dataclass(frozen=True)
class ReviewConfig:
    model_input_budget: int = 12_000
    prompt_overhead: int = 2_000
    safety_margin: int = 1_000
    max_related_files_per_slice: int = 30
    max_file_kb: int = 256
    max_snapshot_mb: int = 50
    symbol_graph: bool = True
    conventions: bool = True
    bm25: bool = False
    co_change: bool = False
    #: Pack so that text which is already shown counts for nothing; off, each item counts in full.
    covering: bool = False
    sensitive_patterns: tuple[str, ...] = SENSITIVE_PATTERNS
    #: Emit bodies of changed methods in sensitive files too. Off: such bodies are withheld like the diff.
    emit_sensitive_methods: bool = False

    @property
    def context_budget(self) -> int:
        """Tokens left for a slice's items."""
        return self.model_input_budget - self.prompt_overhead - self.safety_margin

    def fingerprint(self) -> str:
        """SHA-256 over the settings that change a plan."""
        # Names and order of the settings.
        shown = {
            "modelInputBudget": self.model_input_budget, "promptOverhead": self.prompt_overhead, "safetyMargin": self.safety_margin,
            "maxRelatedFilesPerSlice": self.max_related_files_per_slice, "maxFileKb": self.max_file_kb, "maxSnapshotMb": self.max_snapshot_mb,
            "policy": POLICY_VERSION, "tokenEstimator": TOKENIZER_VERSION, "symbolGraph": self.symbol_graph, "conventions": self.conventions,
            "bm25": self.bm25, "coChange": self.co_change, "sensitivePatterns": ",".join(self.sensitive_patterns),
        }
        shown |= {"packing": "covering"} if self.covering else {}
        lines = (f"{k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in shown.items())
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()
