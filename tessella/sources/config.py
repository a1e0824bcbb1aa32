"""Experiment configurations: checks, arguments and small driver-side files."""

from __future__ import annotations

import time
from collections.abc import Callable

FLAGS = frozenset("time skip_pca use_scaler".split())
# Names of the configurations that the checks look at.
BOX_DATASETS = ("VOC", "voc", "COCO", "coco")
NESTED_ONLY = ("skip_pca", "coarse_to_fine", "use_dim")
NESTED_MARKS = ("matryoshka", "matryoshka_shared_assign")
RANGED = ("distance", "density", "confidence")


def read_config(text: str) -> dict:
    """SC16: a YAML mapping; anything else raises."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    return found


def listed(value: object) -> list[str]:
    """Items of a list, or of a text such as [0.2, 1.0] or 8,4,1."""
    if isinstance(value, (list, tuple)):
        return [str(v) for v in value]
    return [v.strip() for v in str(value).strip("[]").split(",") if v.strip()]


def lint(cfg: dict, name: str = "", known: frozenset[str] | None = None) -> list[tuple[str, str, str]]:
    """(level, rule, message) for each fault; an error forbids the run. known: the keys that prepare_args may have."""
    args, train = cfg.get("prepare_args") or {}, cfg.get("yolo_args") or {}
    mode, data = cfg.get("mode", ""), cfg.get("dataset_name", "")
    nested = any(m in train for m in NESTED_MARKS) or bool(args.get("skip_pca"))
    divisors, weights = train.get("matryoshka_granularity_divs"), train.get("matryoshka_weights")
    uneven = divisors is not None and weights is not None and len(listed(divisors)) != len(listed(weights))
    every = [
        ("error", "plots", not isinstance(cfg.get("plots"), bool), "plots must be true or false"),
        ("warning", "seed", train.get("seed") is None, "without a seed a run can't be repeated"),
        ("error", "lengths", uneven, "as many weights as divisors, please"),
    ]
    strange = sorted(set(args) - known) if known is not None else []
    leaked = [k for k in NESTED_ONLY if args.get(k)] if mode == "distance" and not nested else []
    chain = [
        ("error", "seg2line", bool(args.get("seg2line")) and data in BOX_DATASETS, "seg2line spoils labels that are boxes already"),
        ("error", "ranges", mode in RANGED and len(cfg.get("ranges") or []) < 2, "a chain needs two fractions at least"),
        ("error", "nested", bool(leaked), f"only for nested vectors: {', '.join(leaked)}"),
        ("error", "scaler", bool(args.get("skip_pca") and args.get("use_standard_scaler")), "skip_pca and use_standard_scaler exclude each other"),
        ("error", "keys", bool(strange), f"unknown: {', '.join(strange)}"),
        ("warning", "pretrained", train.get("pretrained") is None and "scratch" in name, "a run from scratch should say so"),
        ("warning", "layers", mode == "distance" and not nested and not args.get("netron_layer_names"), "no layers are named; the default ones are used"),
        ("warning", "subdir", str(data).upper() == "COCO" and args.get("train_subdir", "train") == "train", "these images lie under another folder"),
    ]
    rules = every if cfg.get("type") == "random_train" else every + chain
    return [(level, rule, text) for level, rule, broken, text in rules if broken]


def arguments(args: dict, known: frozenset[str], flags: frozenset[str] = FLAGS) -> list[str]:
    """Command-line arguments; a flag stands alone if true, unknown keys raise."""
    out: list[str] = []
    for key, value in args.items():
        if key not in known:
            raise ValueError(f"unknown key {key}")
        name = "--" + key.replace("_", "-")
        if key in flags:
            out += [name] if value else []
        elif isinstance(value, (list, tuple)):
            out += [name, *map(str, value)]
        elif value is not None:
            out += [name, str(value)]
    return out


def with_train_list(text: str, expected: str, name: str) -> str:
    """SK02: a data-set description whose train entry names another list.

    Only an entry whose file is `expected` is changed; its folder, quotes and
    comment stay. Raises where there is none.
    """
    lines = text.splitlines(keepends=True)
    for i, line in enumerate(lines):
        if not line.startswith("train:"):
            continue
        body, mark, comment = line.rstrip("\n")[len("train:") :].partition("#")
        value = body.strip()
        quote = value[0] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else ""
        folder, slash, file = value.strip(quote or None).rpartition("/")
        if file != expected:
            continue
        end = "\n" if line.endswith("\n") else ""
        lines[i] = f"train: {quote}{folder}{slash}{name}{quote}" + (f" #{comment}" if mark else "") + end
        return "".join(lines)
    raise ValueError(f"no train entry that names {expected}")


def threshold(text: str) -> float:
    """SC18: the first line as a number."""
    return float(text.splitlines()[0])


class StepTimer:
    """SK08: seconds between marks, by name."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.last, self.steps = clock, clock(), []

    def mark(self, name: str) -> None:
        now = self.clock()
        self.steps.append((name, now - self.last))
        self.last = now

    def text(self) -> str:
        return "".join(f"{n}\t{s:.3f}\n" for n, s in self.steps)
