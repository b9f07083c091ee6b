"""JSON-RPC over a WebSocket: one connection a reader, answers told apart by their ids, dialled anew after it breaks."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
from collections.abc import Callable
from urllib.parse import urlsplit

#: Fixed values of RFC 6455: the handshake's key suffix, and the kinds of frames.
ACCEPT = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
CONTINUED, TEXT, BINARY, CLOSE, PING, PONG = 0, 1, 2, 8, 9, 10


def frame(kind: int, data: bytes, mask: bytes | None) -> bytes:
    """A whole frame; what a client sends has a mask of four bytes."""
    bit = 128 if mask else 0
    size = bytes([bit | len(data)]) if len(data) < 126 else bytes([bit | 126]) + struct.pack(">H", len(data)) if len(data) < 65536 else bytes([bit | 127]) + struct.pack(">Q", len(data))
    return bytes([128 | kind]) + size + (mask + masked(data, mask) if mask else data)


def masked(data: bytes, mask: bytes) -> bytes:
    full = (mask * (len(data) // 4 + 1))[: len(data)]
    return (int.from_bytes(data, "big") ^ int.from_bytes(full, "big")).to_bytes(len(data), "big")


def read_frame(stream) -> tuple[int, bool, bytes]:
    """(kind, whether it ends its message, data)."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise ConnectionError("the connection ended")
        return got

    first, second = take(2)
    size = second & 127
    if size > 125:
        size = struct.unpack(">H", take(2))[0] if size == 126 else struct.unpack(">Q", take(8))[0]
    mask = take(4) if second & 128 else None
    data = take(size)
    return first & 15, bool(first & 128), masked(data, mask) if mask else data


class Connection:
    def __init__(self, url: str, timeout: float):
        at = urlsplit(url)
        secure = at.scheme == "wss"
        port = at.port or (443 if secure else 80)
        raw = socket.create_connection((at.hostname, port), timeout)
        self.socket = ssl.create_default_context().wrap_socket(raw, server_hostname=at.hostname) if secure else raw
        self.stream = self.socket.makefile("rb")
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        lines = [f"GET {path} HTTP/1.1", f"Host: {at.hostname}:{port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13", "", ""]
        self.socket.sendall("\r\n".join(lines).encode())
        status = self.stream.readline().split()
        headers = {}
        while (line := self.stream.readline().strip()):
            name, _, value = line.decode("latin-1").partition(":")
            headers[name.strip().lower()] = value.strip()
        wanted = base64.b64encode(hashlib.sha1((key + ACCEPT).encode()).digest()).decode()  # noqa: S324
        if len(status) < 2 or status[1] != b"101" or headers.get("sec-websocket-accept") != wanted:
            raise ConnectionError(f"no WebSocket: {b' '.join(status).decode('latin-1')}")

    def send(self, kind: int, data: bytes) -> None:
        self.socket.sendall(frame(kind, data, os.urandom(4)))

    def message(self) -> bytes:
        """The next message; pings are answered on the way."""
        parts: list[bytes] = []
        while True:
            kind, ends, data = read_frame(self.stream)
            if kind == PING:
                self.send(PONG, data)
            elif kind == CLOSE:
                raise ConnectionError("closed by the other side")
            elif kind in (CONTINUED, TEXT, BINARY):
                parts.append(data)
                if ends:
                    return b"".join(parts)

    def close(self) -> None:
        self.stream.close()
        self.socket.close()


def ws_transport(url: str, timeout: float = 10.0, idle: float = 20.0, dials: int = 4, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[dict]], list[dict]]:
    """Sends a batch and gathers the answers to its ids, in one message or several. A connection that broke, or that has been idle for
    long and doesn't answer a ping, is dialled anew, with growing pauses."""
    from blockloom.sources.rpc import RpcError

    held: dict = {"connection": None, "used": 0.0}

    def dial() -> Connection:
        for k in range(dials):
            try:
                return Connection(url, timeout)
            except OSError as e:
                if k == dials - 1:
                    raise RpcError(f"no connection: {e}", kind="connection") from e
                sleep(0.1 * 2**k)
        raise AssertionError

    def alive(connection: Connection | None) -> bool:
        if connection is None or time.monotonic() - held["used"] < idle:
            return connection is not None
        try:
            connection.send(PING, b"")
            while True:
                if read_frame(connection.stream)[0] == PONG:
                    return True
        except OSError:
            connection.close()
            return False

    def send(calls: list[dict]) -> list[dict]:
        if not alive(held["connection"]):
            held["connection"] = dial()
        connection, waiting, answers = held["connection"], {c["id"] for c in calls}, []
        try:
            connection.send(TEXT, json.dumps(calls if len(calls) > 1 else calls[0]).encode())
            while waiting:
                got = json.loads(connection.message())
                for a in got if isinstance(got, list) else [got]:
                    if a.get("id") in waiting:  # others are notices or late answers
                        waiting.discard(a["id"])
                        answers.append(a)
                    elif a.get("id") is None and a.get("error"):
                        raise RpcError(a["error"].get("message", ""), a["error"].get("code"))
            held["used"] = time.monotonic()
            return answers
        except (OSError, json.JSONDecodeError) as e:
            connection.close()
            held["connection"] = None
            kind = "timeout" if isinstance(e, TimeoutError) else "protocol" if isinstance(e, json.JSONDecodeError) else "connection"
            raise RpcError(f"the connection broke: {e}", kind=kind) from e

    return send
