"""Chat clients: what a model stage calls. A connect function is picklable and is called once in each Python worker."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import urlsplit

LOOPBACK = ("127.0.0.1", "localhost", "::1")
#: Variables that would send a command's requests elsewhere or bill them to another account.
SCRUBBED = re.compile(r"(?i)(_API_KEY|_AUTH_TOKEN|_BASE_URL)\Z|\A(http|https|all)_proxy\Z")


def valid_endpoint(url: str) -> str:
    """url without a slash at the end, if it is http on this machine with a port, the path /v1 and nothing else."""
    parts = urlsplit(url)
    try:
        port = parts.port
    except ValueError:
        port = None
    if parts.scheme != "http" or parts.hostname not in LOOPBACK or not port or parts.username or parts.password or parts.query or parts.fragment or parts.path.rstrip("/") != "/v1":
        raise ValueError(f"not a local endpoint: {url}")
    return url.rstrip("/")


@dataclass(frozen=True)
class HttpClient:
    """Chat completions over HTTP, without a proxy: temperature 0, and an answer counts only if it was finished."""

    endpoint: str
    model: str
    presence_penalty: float = 0.0
    timeout: float = 900

    def __call__(self) -> HttpClient:
        valid_endpoint(self.endpoint)
        return self

    def ask(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "presence_penalty": self.presence_penalty, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{self.endpoint.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=self.timeout) as reply:
                told = json.load(reply)
        except (OSError, ValueError) as e:
            raise RuntimeError(f"no answer from the model: {e}") from e
        return finished(told)


def finished(told: object) -> str:
    """The text of a chat completion. ValueError if the model stopped early or said nothing, RuntimeError if it is no completion."""
    match told:
        case {"choices": [{"finish_reason": "stop", "message": {"content": str(text)}}, *_]} if text.strip():
            return text.strip()
        case {"choices": [{"finish_reason": why}, *_]}:
            raise ValueError(f"the answer was not finished: {why}")
    raise RuntimeError("no answer from the model: not a completion")


@dataclass(frozen=True)
class CommandClient:
    """A command that reads the prompt (system text, blank line, user text) and prints the answer, run in an empty folder
    with an environment that has no keys, endpoints or proxies."""

    command: tuple[str, ...]
    timeout: float = 900

    def __call__(self) -> CommandClient:
        return self

    def ask(self, system: str, user: str) -> str:
        env = {k: v for k, v in os.environ.items() if not SCRUBBED.search(k)}
        with tempfile.TemporaryDirectory() as empty:
            try:
                done = subprocess.run(self.command, input=f"{system}\n\n{user}", text=True, capture_output=True, timeout=self.timeout, cwd=empty, env=env, check=False)
            except (OSError, subprocess.TimeoutExpired) as e:
                raise RuntimeError(f"the command did not run: {e}") from e
        if done.returncode or not done.stdout.strip():
            raise RuntimeError(f"the command failed: {done.stderr.strip()[:200]}")
        return done.stdout.strip()


def connect_to(config: dict):
    """The connect function of {"engine": "http", "endpoint", "model", ...} or {"engine": "command", "command", ...};
    per_second bounds the requests of each worker."""
    config = dict(config)
    engine, rate = config.pop("engine", None), config.pop("per_second", None)
    if engine == "http":
        own = HttpClient(**config | {"endpoint": valid_endpoint(config["endpoint"])})
    elif engine == "command":
        own = CommandClient(**config | {"command": tuple(config["command"])})
    else:
        raise ValueError(f"no such engine: {engine}")
    return Paced(own, rate)


@dataclass(frozen=True)
class Paced:
    """A client that starts at most per_second requests a second (None: any number)."""

    client: HttpClient | CommandClient
    per_second: float | None = None

    def __call__(self):
        client, last = self.client(), [0.0]

        def chat(system: str, user: str) -> str:
            if self.per_second:
                time.sleep(max(0.0, last[0] + 1 / self.per_second - time.monotonic()))
                last[0] = time.monotonic()
            return client.ask(system, user)

        return chat
