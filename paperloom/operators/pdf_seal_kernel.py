"""PDF files with and without a password. Plain Python.

A file's objects are read, and written anew in order with a plain cross-reference table; object streams are dissolved.
"""

from __future__ import annotations

import hashlib
import os

from paperloom.operators import aes_kernel as aes
from paperloom.operators.pdf_kernel import PADDING, _rc4
from paperloom.operators.pdf_text_kernel import BROKEN, File, Name, Ref, Sealed, Stream, Word

#: Bits of what a file allows, by the standard; assembling goes with modifying, reading aloud is always allowed.
ALWAYS, PRINT, MODIFY, COPY, ANNOTATE, FILL, ASSEMBLE, PRINT_FINE = 0xFFFFF0C0 | 512, 4, 8, 16, 32, 256, 1024, 2048


def permission_bits(printing: str = "full", modifying: bool = True, copying: bool = True, annotating: bool = True, filling: bool = True) -> int:
    """As the signed number that files hold; printing is none, low or full."""
    bits = ALWAYS | PRINT * (printing != "none") | PRINT_FINE * (printing == "full") | (MODIFY | ASSEMBLE) * modifying | COPY * copying | ANNOTATE * annotating | FILL * filling
    return bits - (1 << 32)


def _written(value) -> bytes:
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in value.encode("latin-1", "replace"))
    if isinstance(value, bool) or value is None:
        return {True: b"true", False: b"false", None: b"null"}[value]
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, list):
        return b"[" + b" ".join(map(_written, value)) + b"]"
    if isinstance(value, dict):
        return b"<< " + b" ".join(_written(k) + b" " + _written(v) for k, v in value.items()) + b" >>"
    return repr(value).encode() if isinstance(value, (int, float)) else b"null" if isinstance(value, Word) else str(value).encode()


def _sealed(value, seal):
    """``value`` with each string sealed."""
    if isinstance(value, bytes):
        return seal(value)
    if isinstance(value, list):
        return [_sealed(v, seal) for v in value]
    return {k: _sealed(v, seal) for k, v in value.items()} if isinstance(value, dict) else value


def _rewritten(file: File, sealer=None, how: dict | None = None, first: bytes = b"") -> bytes:
    """The file's objects anew; ``sealer`` gives an object's cipher by its number, ``how`` is the dictionary that says so."""
    old = file.trailer.get("Encrypt")
    left_out = {old.number} if isinstance(old, Ref) else set()
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def add(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    for number in sorted({*file.place, *file.known} - left_out):
        value = file.get(Ref(number))
        if value is None or (isinstance(value, Stream) and value.head.get("Type") in ("XRef", "ObjStm")):
            continue
        seal = sealer(number) if sealer else lambda raw: raw
        if isinstance(value, Stream):
            raw = seal(value.raw)
            add(number, _written(_sealed(value.head, seal) | {Name("Length"): len(raw)}) + b"\nstream\n" + raw + b"\nendstream")
        else:
            add(number, _written(_sealed(value, seal)))
    trailer = {Name(k): file.trailer[k] for k in ("Root", "Info") if k in file.trailer}
    if how:
        number = max(places, default=0) + 1
        add(number, _written(how))
        trailer |= {Name("Encrypt"): Ref(number), Name("ID"): [first, first]}
    size, start = max(places, default=0) + 1, len(out)
    rows = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00001 f \n" for n in range(1, size))
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size + rows
    return bytes(out + b"trailer\n" + _written(trailer | {Name("Size"): size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def _how(names: dict) -> dict:
    return {Name(k): v for k, v in names.items()}


def _modern(user: bytes, owner: bytes, allowed: int) -> tuple[dict, bytes]:
    """AES of 256 bits: the key is random and sealed by either password."""
    key, salts = os.urandom(32), os.urandom(32)

    def marks(word: bytes, salt: bytes, rest: bytes) -> tuple[bytes, bytes]:
        return hashlib.sha256(word + salt[:8] + rest).digest() + salt, aes.encrypt(hashlib.sha256(word + salt[8:] + rest).digest(), key)

    mark, sealed = marks(user, salts[:16], b"")
    owner_mark, owner_sealed = marks(owner, salts[16:], mark)
    perms = aes.encrypt(key, (allowed & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + os.urandom(4))
    filters = {"CF": _how({"StdCF": _how({"AuthEvent": Name("DocOpen"), "CFM": Name("AESV3"), "Length": 32})}), "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return _how({"Filter": Name("Standard"), "V": 5, "R": 5, "Length": 256, "O": owner_mark, "U": mark, "OE": owner_sealed, "UE": sealed, "P": allowed, "Perms": perms} | filters), key


def _classic(user: bytes, owner: bytes, allowed: int, first: bytes) -> tuple[dict, bytes]:
    """AES of 128 bits, its key from the user's password, which the owner's seals."""
    seal = hashlib.md5((owner + PADDING)[:32]).digest()
    for _ in range(50):
        seal = hashlib.md5(seal).digest()
    owner_mark = (user + PADDING)[:32]
    for i in range(20):
        owner_mark = _rc4(bytes(b ^ i for b in seal), owner_mark)
    key = hashlib.md5((user + PADDING)[:32] + owner_mark + (allowed & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    mark = hashlib.md5(PADDING + first).digest()
    for i in range(20):
        mark = _rc4(bytes(b ^ i for b in key), mark)
    filters = {"CF": _how({"StdCF": _how({"AuthEvent": Name("DocOpen"), "CFM": Name("AESV2"), "Length": 16})}), "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return _how({"Filter": Name("Standard"), "V": 4, "R": 4, "Length": 128, "O": owner_mark, "U": mark + bytes(16), "P": allowed} | filters), key


def protect(data: bytes, user: str = "", owner: str | None = None, allowed: int | None = None, cipher: str = "AES-256", password: str | None = None) -> dict:
    """{"content", "error"} with the file sealed; ``password`` opens it if it is sealed already. Without an owner's password the
    user's is taken; ``allowed`` comes from :func:`permission_bits`."""
    allowed, owner = permission_bits() if allowed is None else allowed, user if owner is None else owner
    first = os.urandom(16)

    def sealed(file: File) -> bytes:
        if cipher == "AES-256":
            how, key = _modern(user.encode()[:127], owner.encode()[:127], allowed)
            of = lambda number: key
        else:
            how, key = _classic(user.encode("cp1252", "replace"), owner.encode("cp1252", "replace"), allowed, first)
            of = lambda number: hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0sAlT").digest()

        def sealer(number: int):
            def seal(raw: bytes) -> bytes:
                start = os.urandom(16)
                return start + aes.encrypt(of(number), aes.padded(raw), start)

            return seal

        return _rewritten(file, sealer, how, first)

    return _tried(data, password, sealed)


def unlock(data: bytes, password: str | None = None) -> dict:
    """{"content", "error"} with the file in plain."""
    return _tried(data, password, _rewritten)


def _tried(data: bytes, password: str | None, work) -> dict:
    try:
        file = File(data, password)
        if not file.pages():
            return {"content": None, "error": "damaged"}
        return {"content": work(file), "error": None}
    except Sealed as why:
        return {"content": None, "error": str(why)}
    except BROKEN:
        return {"content": None, "error": "damaged"}
