"""Rule data: scores, thresholds and lists, and how an overlay is merged into them.

Lists and sets are united, numbers and texts are replaced, hash seeds are united by sha256 with the baseline first.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, replace

# Severities and their points, verdict thresholds, the cap for each category.
SEVERITY_POINTS = {"low": 1, "medium": 8, "high": 25, "critical": 60}
THRESHOLDS = {"suspicious_min": 20, "malicious_min": 61, "category_cap": 30, "whitespace_min_leading_spaces": 200}

# Rules that stand for a whole chain of behaviour.
CHAIN_IDS = (
    "installer.urlopen_exec_chain", "installer.npm_install_obfuscated_entrypoint", "installer.npm_runtime_obfuscated_entrypoint",
    "installer.npm_install_persistence_loader", "imports.network_subprocess_chain", "malware.deobfuscation_exec_chain",
    "malware.discord_webhook", "malware.env_exfil_tainted", "malware.pth_exec_injection", "dyn_install_exfil", "dyn_reverse_shell",
    "dyn_proc_inject",
)

# Words of names that lure.
LURE_KEYWORDS = {
    "crypto": ("wallet", "mnemonic", "blockchain", "web3-", "defi-", "nft-"),
    "security_theater": ("security-", "-security", "scanner", "audit", "verifier", "validator"),
    "credential_secret": ("credential", "secret", "api-key", "access-token", "password-", "ssh-key"),
}

# Hosts that are no indicator.
BENIGN_HOSTS = (
    "pypi.org", "files.pythonhosted.org", "crates.io", "static.crates.io", "docs.rs", "proxy.golang.org", "index.golang.org", "pkg.go.dev",
    "npmjs.org", "npmjs.com", "rubygems.org", "packagist.org", "github.com", "github.io", "githubusercontent.com", "raw.githubusercontent.com",
    "gitlab.com", "bitbucket.org", "python.org", "docs.python.org", "readthedocs.io", "readthedocs.org", "w3.org", "ietf.org", "apache.org",
    "mozilla.org", "opensource.org", "spdx.org", "example.com", "example.org", "example.net", "example.invalid", "localhost", "127.0.0.1",
    "api.anthropic.com", "api.openai.com", "api.groq.com", "api.x.ai", "api.mistral.ai", "api.deepseek.com", "api.cohere.ai", "api.cohere.com", "api.together.xyz",
    "api.perplexity.ai", "integrate.api.nvidia.com", "generativelanguage.googleapis.com", "openrouter.ai", "opencode.ai",
)

# Files that run while a package is installed, by the rules that look at them.
INSTALL_FILES = {
    "install_time_all": ("setup.py", "setup.cfg", "install.py", "post_install.py", "conftest.py"),
    "credential_targets": ("setup.py", "setup.cfg", "install.py", "post_install.py"),
    "deobfuscation_targets": ("setup.py", "install.py", "post_install.py"),
    "download_targets": ("setup.py", "install.py", "post_install.py"),
}
SHADOW_PREFIX = "opengrep.shadow_"
SENTINEL_RANK = 9_999_999


@dataclass(frozen=True)
class Pack:
    points: dict = field(default_factory=lambda: dict(SEVERITY_POINTS))
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    chains: frozenset = frozenset(CHAIN_IDS)
    lures: dict = field(default_factory=lambda: dict(LURE_KEYWORDS))
    benign_hosts: frozenset = frozenset(BENIGN_HOSTS)
    install_files: dict = field(default_factory=lambda: dict(INSTALL_FILES))
    seeds: tuple = ()
    prompts: dict = field(default_factory=dict)


def united(base: dict, more: dict) -> dict:
    """Lists by key, united in order."""
    return {key: tuple(dict.fromkeys([*base.get(key, ()), *more.get(key, ())])) for key in {**base, **more}}


def merge(base: Pack, overlay: Pack) -> Pack:
    known = {x["sha256"] for x in base.seeds}
    return replace(
        base,
        points=base.points | overlay.points,
        thresholds=base.thresholds | overlay.thresholds,
        chains=base.chains | overlay.chains,
        lures=united(base.lures, overlay.lures),
        benign_hosts=base.benign_hosts | overlay.benign_hosts,
        install_files=united(base.install_files, overlay.install_files),
        seeds=(*base.seeds, *(x for x in overlay.seeds if x["sha256"] not in known)),
        prompts=base.prompts | {k: v for k, v in overlay.prompts.items() if v},
    )


def numbers(told: dict) -> dict:
    """Only true numbers; booleans and texts are refused."""
    wrong = [k for k, v in told.items() if isinstance(v, bool) or not isinstance(v, (int, float))]
    if wrong:
        raise ValueError(f"not numbers: {', '.join(sorted(wrong))}")
    return dict(told)


def read_toml(text: str) -> Pack:
    """A pack from one TOML text with the tables points, thresholds, chains, lures, benign_hosts, install_files and prompts, all optional."""
    told = tomllib.loads(text)
    return Pack(
        numbers(told.get("points", {})), numbers(told.get("thresholds", {})), frozenset(told.get("chains", ())), told.get("lures", {}),
        frozenset(told.get("benign_hosts", ())), told.get("install_files", {}), (), told.get("prompts", {}),
    )


def read_seeds(lines: list[str]) -> tuple[tuple, int]:
    """Hash seeds from JSON lines, and how many lines were malformed and left out."""
    seeds, dropped = [], 0
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        try:
            seed = json.loads(line)
            seeds.append(seed | {"sha256": seed["sha256"].lower()})
        except (ValueError, KeyError, TypeError, AttributeError):
            dropped += 1
    return tuple(seeds), dropped


BASELINE = Pack()
