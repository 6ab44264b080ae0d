"""Events as lines of JSON over TCP, TLS and UDP.

``spark.dataSource.register(NdjsonSocket)`` offers the format
``ndjson_socket``. Reading, a task on one executor listens and hands over
what has come in; writing, each partition connects as a client.
"""

from __future__ import annotations

import contextlib
import json
import os
import select
import socket
import ssl
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

PORT = 8125


def certificate(paths: str | list[str]) -> list[bytes] | None:
    """PEM files' contents; None if one is missing."""
    wanted = [paths] if isinstance(paths, str) else paths
    if not all(os.path.exists(p) for p in wanted):
        return None
    out = []
    for p in wanted:
        with open(p, "rb") as f:
            out.append(f.read())
    return out


def server_context(cert: str, key: str, ca: str | None = None) -> ssl.SSLContext:
    """TLS for a listener; with ``ca``, clients must show a certificate that it signed."""
    out = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
    out.load_cert_chain(cert, key)
    if ca:
        out.load_verify_locations(ca)
        out.verify_mode = ssl.CERT_REQUIRED
    return out


def client_context(ca: str, cert: str | None = None, key: str | None = None) -> ssl.SSLContext:
    """TLS for a client that trusts one authority."""
    out = ssl.create_default_context(cafile=ca)
    if cert:
        out.load_cert_chain(cert, key)
    return out


class Listener:
    """Collects whole lines from clients of a TCP or TLS port, or from datagrams of a UDP port."""

    def __init__(self, kind: str = "tcp", port: int = PORT, address: str = "0.0.0.0", ipv6: bool = False, context: ssl.SSLContext | None = None) -> None:
        family = socket.AF_INET6 if ipv6 else socket.AF_INET
        self.kind, self.context, self.rest = kind, context, {}
        self.server = socket.socket(family, socket.SOCK_DGRAM if kind == "udp" else socket.SOCK_STREAM)
        self.server.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.server.bind((address, port))
        self.server.setblocking(False)
        self.clients: list[socket.socket] = []
        if kind != "udp":
            self.server.listen()
        self.port = self.server.getsockname()[1]

    def lines(self, wait: float = 0.1) -> list[str]:
        """Lines that are complete after waiting so many seconds at most."""
        out: list[str] = []
        end = time.monotonic() + wait
        while (left := end - time.monotonic()) > 0:
            ready, _, _ = select.select([self.server, *self.clients], [], [], left)
            for s in ready:
                if s is self.server and self.kind != "udp":
                    self._accept()
                else:
                    out += self._read(s)
        return out

    def _accept(self) -> None:
        with contextlib.suppress(OSError):  # a failed handshake ends one client, not the listener
            client, _ = self.server.accept()
            if self.context:
                client.settimeout(5)
                client = self.context.wrap_socket(client, server_side=True)
            client.setblocking(False)
            self.clients.append(client)

    def _read(self, s: socket.socket) -> list[str]:
        data = b""
        try:
            while True:
                part = s.recvfrom(65_536)[0] if self.kind == "udp" else s.recv(65_536)
                if not part and self.kind != "udp":
                    self.clients.remove(s)
                    s.close()
                    break
                data += part
        except (BlockingIOError, ssl.SSLWantReadError):
            pass
        except OSError:
            self.clients.remove(s)
            s.close()
        *whole, self.rest[s] = (self.rest.get(s, b"") + data).split(b"\n")
        return [x.decode("utf-8", "replace") for x in whole if x.strip()]

    def close(self) -> None:
        for s in [*self.clients, self.server]:
            s.close()


class Client:
    """Sends events as lines; over UDP one datagram each."""

    def __init__(self, kind: str = "tcp", port: int = PORT, address: str = "127.0.0.1", ipv6: bool = False, context: ssl.SSLContext | None = None) -> None:
        self.kind, self.to = kind, (address, port)
        self.socket = socket.socket(socket.AF_INET6 if ipv6 else socket.AF_INET, socket.SOCK_DGRAM if kind == "udp" else socket.SOCK_STREAM)
        if kind != "udp":
            self.socket.connect(self.to)
            if context:
                self.socket = context.wrap_socket(self.socket, server_hostname=address)

    def emit(self, event: dict) -> None:
        line = json.dumps(event, default=str).encode() + b"\n"
        if self.kind == "udp":
            self.socket.sendto(line, self.to)
        else:
            self.socket.sendall(line)

    def close(self) -> None:
        self.socket.close()


def _context(options: dict, server: bool) -> ssl.SSLContext | None:
    if options.get("kind", "tcp") != "tls":
        return None
    return server_context(options["cert"], options["key"], options.get("ca")) if server else client_context(options["ca"], options.get("cert"), options.get("key"))


def _endpoint(options: dict) -> dict:
    kind = options.get("kind", "tcp")
    return {"kind": "tcp" if kind == "tls" else kind, "port": int(options.get("port", PORT)), "ipv6": options.get("ipv6", "false") == "true"}


class _Reader(SimpleDataSourceStreamReader):
    """Offsets count lines; lines not yet committed are kept for a replay."""

    def __init__(self, options: dict) -> None:
        self.options, self.listener, self.kept, self.first = dict(options), None, [], 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.listener is None:
            self.listener = Listener(**_endpoint(self.options), address=self.options.get("address", "0.0.0.0"), context=_context(self.options, True))
            self.first = start["n"]
        self.kept += self.listener.lines(float(self.options.get("wait", "0.2")))
        rows = self.kept[start["n"] - self.first :]
        return iter([(x,) for x in rows]), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self.kept[start["n"] - self.first : end["n"] - self.first]])

    def commit(self, end: dict) -> None:
        self.kept = self.kept[max(0, end["n"] - self.first) :]
        self.first = max(self.first, end["n"])


class _Sender:
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        client = Client(**_endpoint(self.options), address=self.options.get("address", "127.0.0.1"), context=_context(self.options, False))
        for r in rows:
            client.emit(r.asDict(recursive=True))
        client.close()
        return WriterCommitMessage()


class _Writer(_Sender, DataSourceWriter):
    pass


class _StreamWriter(_Sender, DataSourceStreamWriter):
    pass


class NdjsonSocket(DataSource):
    """Options: kind (tcp, tls, udp), port, address, ipv6, wait; for tls cert, key and ca."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_socket"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options)


def as_lines(df: DataFrame) -> DataFrame:
    """Rows as lines of JSON in ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
