"""Configurations: reading, taking values out, registries, and rules between settings."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable

_MISSING = object()


def take(config: dict, key: str, must_exist: bool = True, default=None, convert: Callable | None = None):
    """The value of ``key``, taken out of ``config``; a missing one is a NameError, or the default."""
    value = config.pop(key, _MISSING)
    if value is _MISSING:
        if must_exist:
            raise NameError(f"the configuration has no {key}")
        return default
    return convert(value) if convert and value is not None else value


def warn_unused(config: dict) -> list[str]:
    for key in config:
        warnings.warn(f"{key} is not used", stacklevel=2)
    return sorted(config)


def merged(base: dict, *others: dict) -> dict:
    """Later settings over earlier ones, level by level."""
    out = dict(base)
    for other in others:
        for key, value in other.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def from_dots(arguments: list[str]) -> dict:
    """``a.b=1`` command-line settings."""
    out: dict = {}
    for argument in arguments:
        path, _, value = argument.partition("=")
        *parents, last = path.split(".")
        at = out
        for parent in parents:
            at = at.setdefault(parent, {})
        at[last] = scalar(value)
    return out


def resolved(config: dict) -> dict:
    """``${a.b}`` replaced by the setting it names."""

    def look(path: str):
        at = config
        for part in path.split("."):
            at = at[part]
        return put(at)

    def put(value):
        if isinstance(value, dict):
            return {k: put(v) for k, v in value.items()}
        if isinstance(value, list):
            return [put(v) for v in value]
        if isinstance(value, str):
            if m := re.fullmatch(r"\$\{([\w.]+)\}", value):
                return look(m[1])
            return re.sub(r"\$\{([\w.]+)\}", lambda m: str(look(m[1])), value)
        return value

    return put(config)


def scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~", "none"):
        return None
    try:
        return int(text.replace("_", ""))
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def parse_yaml(text: str) -> dict:
    """Nested mappings and lists of scalars or mappings, by indentation: what configuration files hold."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", raw).rstrip() for raw in text.splitlines()) if x.strip() and x.strip() != "---"]

    def block(i: int, indent: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out_list = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if not rest:
                    value, i = block(i + 1, lines[i + 1][0])
                elif re.match(r"[\w.-]+:(\s|$)", rest):
                    inner = indent + lines[i][1].index(rest[0], 1)
                    lines[i] = (inner, rest)
                    value, i = block(i, inner)
                else:
                    value, i = scalar(rest), i + 1
                out_list.append(value)
            return out_list, i
        out: dict = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            if rest.strip():
                out[scalar(key)], i = scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("- ")):
                out[scalar(key)], i = block(i + 1, lines[i + 1][0])
            else:
                out[scalar(key)], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


class Registry:
    """Named constructors; an unknown name is a ValueError that lists the known ones."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def add(self, name: str):
        def put(function):
            if name in self.known:
                raise ValueError(f"{self.what} {name} is registered already")
            self.known[name] = function
            return function

        return put

    def build(self, name: str, **settings):
        if name not in self.known:
            raise ValueError(f"no {self.what} {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name](**settings)


loaders = Registry("loader")


def check_source(config: dict) -> str:
    """``hf`` or ``remote``: exactly one source is set, and a remote one names a local folder."""
    hub, remote = config.get("hf_name") is not None, config.get("remote") is not None
    if hub == remote:
        raise ValueError("set either hf_name or remote")
    if remote and config.get("local") is None:
        raise ValueError("a remote source needs a local folder")
    return "hf" if hub else "remote"


# Which model types each loader feeds.
LOADERS_OF = {
    "text": {"mpt_causal_lm", "hf_causal_lm"},
    "finetuning": {"mpt_causal_lm", "hf_causal_lm", "hf_prefix_lm", "hf_t5"},
    "text_denoising": {"hf_prefix_lm", "hf_t5", "mpt_causal_lm"},
}


# The layout that denoising loaders give to models of one layout only.
DECODER_ONLY = {"hf_t5": False, "hf_prefix_lm": True}


def checked_loaders(model: str, loaders: list[dict], icl: bool = False) -> list[dict]:
    """The loaders as ``model`` can be fed by them: a denoising loader's ``decoder_only_format`` is overridden, with a
    warning, where the model has one layout only. Loaders that don't feed the model are an error, and so are in-context
    tasks (``icl``) for an encoder-decoder model."""
    out = []
    for loader in loaders:
        check_loader(loader["name"], model)
        wanted = DECODER_ONLY.get(model)
        if loader["name"] == "text_denoising" and wanted is not None and bool(loader.get("decoder_only_format")) != wanted:
            warnings.warn(f"models of type {model} need decoder_only_format {wanted}", stacklevel=2)
            loader = loader | {"decoder_only_format": wanted}
        out.append(loader)
    if icl and DECODER_ONLY.get(model) is False:
        raise ValueError("in-context tasks don't run on encoder-decoder models")
    return out


def check_loader(loader: str, model: str) -> None:
    if model not in LOADERS_OF.get(loader, set()):
        raise ValueError(f"loader {loader} doesn't feed models of type {model}")


def batch_plan(global_batch: int, devices: int, micro: int | str) -> dict:
    """Batch and microbatch of a device and the gradient accumulation; batches must divide evenly."""
    if global_batch % devices:
        raise ValueError(f"a batch of {global_batch} doesn't divide over {devices} devices")
    device = global_batch // devices
    if micro == "auto":
        return {"device_batch": device, "micro_batch": "auto", "grad_accum": "auto"}
    if micro > device:
        warnings.warn("the microbatch is cut down to the device batch", stacklevel=2)
        micro = device
    return {"device_batch": device, "micro_batch": micro, "grad_accum": math.ceil(device / micro)}


def check_rows(df, batch: int, world: int, drop_last: bool = True) -> int:
    """Rows of a data set; fewer than one batch over all devices is an error where incomplete batches are dropped."""
    n = df.count()
    if drop_last and n < batch * world:
        raise ValueError(f"Your dataset has {n} rows, fewer than the {batch * world} of one batch over all devices")
    return n


def learning_rate(step: int, kind: str, warm_up: int, total: int, floor: float = 0.0) -> float:
    """The schedule's factor: linear warm-up, then constant, linear or cosine decay to ``floor``."""
    if step < warm_up:
        return step / warm_up
    part = min(1.0, (step - warm_up) / max(1, total - warm_up))
    if kind == "constant":
        return 1.0
    if kind == "linear":
        return 1 + (floor - 1) * part
    if kind == "cosine":
        return floor + (1 - floor) * (1 + math.cos(math.pi * part)) / 2
    raise ValueError(f"no schedule {kind}")


def retried(function: Callable, times: int = 3, wait: float = 1.0, errors: tuple[type[Exception], ...] = (Exception,)):
    """``function()``, tried again after errors, each time after twice the wait; the last error is raised."""
    import time

    for attempt in range(times):
        try:
            return function()
        except errors:
            if attempt == times - 1:
                raise
            time.sleep(wait * 2**attempt)


def raw_limit(setting: int | str | None, starts: list[int]) -> int | None:
    """Most raw tokens a denoiser reads: the least or greatest that its noisers can, a number, or no limit of its own."""
    if setting is None:
        return None
    if setting == "min":
        return min(starts)
    if setting == "max":
        return max(starts)
    if not isinstance(setting, int) or setting < 1:
        raise ValueError("a limit is min, max, a positive number, or none")
    return setting
