"""Remote use: an engine behind a TCP port, and its client.

A request is SQL text; each statement that a semicolon ends is answered by its
rows as they arrive, then ``OK`` or an error, then ``END``.
"""

from __future__ import annotations

import socket
import socketserver
import threading
from collections.abc import Callable, Iterable, Iterator

from larkspur.plans.dialect import DialectError, split_statements
from larkspur.session import Engine, Result

# What rows, success, errors and the end of an answer look like.
ROW, SUCCESS, ERROR, END = b"ROW ", b"OK\n", b"ERROR: ", b"END\n"


def _sized(text: str) -> bytes:
    raw = text.encode()
    return b"%d:%s" % (len(raw), raw)


def encode_row(columns: Iterable[str], values: Iterable[str]) -> bytes:
    """A count, then name and value of each column with their lengths in bytes."""
    pairs = [_sized(c) + _sized(v) for c, v in zip(columns, values, strict=True)]
    return ROW + b"%d " % len(pairs) + b"".join(pairs) + b"\n"


def statements_in(held: str) -> tuple[list[str], str]:
    """Statements that have ended, and the rest; semicolons in quotes end nothing."""
    quoted, end = False, 0
    for i, c in enumerate(held):
        quoted ^= c == "'"
        if c == ";" and not quoted:
            end = i + 1
    return split_statements(held[:end]), held[end:]


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        held = b""
        while data := self.request.recv(1 << 16):
            held += data
            try:
                found, rest = statements_in(held.decode())
            except UnicodeDecodeError:
                continue  # a character is still on its way
            held = rest.encode()
            for statement in found:
                self.wfile.write(self._answer(statement))

    def _answer(self, statement: str) -> bytes:
        """Writes the rows; what remains to be written after them."""
        try:
            self.server.engine.exec(statement, lambda columns, row: self.wfile.write(encode_row(columns, row)) and None)
        except DialectError as e:
            return ERROR + str(e).encode() + b"\n" + END
        except OSError:
            raise
        except Exception as e:  # the connection outlives a failed query
            return ERROR + str(e).splitlines()[0].encode() + b"\n" + END
        return SUCCESS + END


class Server(socketserver.ThreadingTCPServer):
    """``with Server(engine, port=...)`` answers clients, each in a thread of its own, until the block ends."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0):
        super().__init__((host, port), _Handler)
        self.engine = engine
        self.port = self.server_address[1]

    def __enter__(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()
        self.server_close()


class Client:
    """exec() as an engine has it, over a connection."""

    def __init__(self, host: str, port: int):
        self.socket = socket.create_connection((host, port))
        self.stream = self.socket.makefile("rb")

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.stream.close()
        self.socket.close()

    def exec(self, text: str, callback: Callable[[tuple[str, ...], tuple[str, ...]], object] | None = None) -> list[Result]:
        """As Engine.exec; a callback that returns true gets no further rows."""
        results, stopped = [], False
        for statement in split_statements(text):
            if stopped:
                break
            self.socket.sendall(f"{statement};".encode())
            columns, rows = (), []
            for columns, row in self._rows():
                if not callback:
                    rows.append(row)
                elif not stopped:
                    stopped = bool(callback(columns, row))
            results.append(Result(columns, tuple(rows)))
        return results

    def _text(self) -> str:
        size = b""
        while (c := self.stream.read(1)) != b":":
            size += c
        return self.stream.read(int(size)).decode()

    def _rows(self) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
        while True:
            first = self.stream.read(1)
            if first == ROW[:1]:
                self.stream.read(len(ROW) - 1)
                count = b""
                while (c := self.stream.read(1)) != b" ":
                    count += c
                pairs = [(self._text(), self._text()) for _ in range(int(count))]
                self.stream.read(1)
                yield tuple(c for c, _ in pairs), tuple(v for _, v in pairs)
                continue
            line = first + self.stream.readline()
            if line == END:
                return
            if not line:
                raise ConnectionError("the server closed the connection")
            if line.startswith(ERROR):
                self.stream.readline()
                raise DialectError(line[len(ERROR) :].decode().rstrip("\n"))


def connect(host: str, port: int) -> Client:
    return Client(host, port)
