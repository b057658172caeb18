"""Z80 and R800 disassembly, decoded by the fields of the opcode byte: x = bits 7-6, y = bits 5-3, z = bits 2-0."""

from __future__ import annotations

# Names of the processor's registers, conditions and operations in opcode order.
R = ("B", "C", "D", "E", "H", "L", "(HL)", "A")
RP = ("BC", "DE", "HL", "SP")
RP2 = ("BC", "DE", "HL", "AF")
CC = ("NZ", "Z", "NC", "C", "PO", "PE", "P", "M")
ALU = ("ADD A,", "ADC A,", "SUB ", "SBC A,", "AND ", "XOR ", "OR ", "CP ")
ROT = ("RLC", "RRC", "RL", "RR", "SLA", "SRA", "SLL", "SRL")
ACC = ("RLCA", "RRCA", "RLA", "RRA", "DAA", "CPL", "SCF", "CCF")
BLOCKS = (("LDI", "CPI", "INI", "OUTI"), ("LDD", "CPD", "IND", "OUTD"), ("LDIR", "CPIR", "INIR", "OTIR"), ("LDDR", "CPDR", "INDR", "OTDR"))
IM = ("0", "0", "1", "2", "0", "0", "1", "2")
ED7 = ("LD I,A", "LD R,A", "LD A,I", "LD A,R", "RRD", "RLD")


class _Short(Exception):
    pass


class _Reader:
    def __init__(self, code: bytes, pc: int):
        self.code, self.pc, self.at = code, pc, 0

    def byte(self) -> int:
        if self.at >= len(self.code):
            raise _Short
        self.at += 1
        return self.code[self.at - 1]

    def n(self) -> str:
        return f"0x{self.byte():02X}"

    def nn(self) -> str:
        low = self.byte()
        return f"0x{low + 256 * self.byte():04X}"

    def target(self) -> str:
        d = self.byte()
        return f"0x{(self.pc + self.at + d - (256 if d > 127 else 0)) & 0xFFFF:04X}"


def _offset(d: int) -> str:
    return f"-0x{256 - d:02X}" if d > 127 else f"+0x{d:02X}"


def decode(code: bytes, pc: int = 0) -> tuple[int, str]:
    """Length and text of the first instruction. A cut-off instruction takes all that is left as data."""
    r = _Reader(code, pc)
    try:
        op = r.byte()
        if op == 0xCB:
            text = _cb(r.byte(), None)
        elif op == 0xED:
            op = r.byte()
            text = _ed(r, op)
        elif op in (0xDD, 0xFD):
            if r.at < len(code) and code[r.at] in (0xDD, 0xFD, 0xED):
                return 1, f"DB 0x{op:02X}"
            index, op = ("IX" if op == 0xDD else "IY"), r.byte()
            if op == 0xCB:
                place = f"({index}{_offset(r.byte())})"
                text = _cb(r.byte(), place)
            else:
                text = _main(r, op, index)
        else:
            text = _main(r, op, None)
        return r.at, text
    except _Short:
        return len(code), "DB " + ", ".join(f"0x{b:02X}" for b in code)


def _cb(op: int, place: str | None) -> str:
    x, y, z = op >> 6, op >> 3 & 7, op & 7
    name = ROT[y] + " " if not x else ("BIT", "RES", "SET")[x - 1] + f" {y},"
    if place is None:
        return name + R[z]
    return name + place + ("" if z == 6 or x == 1 else "," + R[z])


def _ed(r: _Reader, op: int) -> str:
    x, y, z = op >> 6, op >> 3 & 7, op & 7
    p, q = y >> 1, y & 1
    if op in (0xC1, 0xC9, 0xD1, 0xD9):
        return f"MULUB A,{R[y]}"
    if op in (0xC3, 0xF3):
        return f"MULUW HL,{RP[p]}"
    if x == 2 and y >= 4 and z < 4:
        return BLOCKS[y - 4][z]
    if x != 1 or (z == 7 and y > 5):
        return f"DB 0xED, 0x{op:02X}"
    if z == 0:
        return f"IN {'F' if y == 6 else R[y]},(C)"
    if z == 1:
        return f"OUT (C),{'0' if y == 6 else R[y]}"
    if z == 2:
        return f"{'ADC' if q else 'SBC'} HL,{RP[p]}"
    if z == 3:
        place = r.nn()
        return f"LD {RP[p]},({place})" if q else f"LD ({place}),{RP[p]}"
    return ("NEG", "RETI" if y == 1 else "RETN", f"IM {IM[y]}", ED7[y] if y < 6 else "")[z - 4]


def _main(r: _Reader, op: int, index: str | None) -> str:
    x, y, z = op >> 6, op >> 3 & 7, op & 7
    p, q = y >> 1, y & 1
    # (HL) becomes (IX+d), whose displacement follows the opcode; H and L beside it stay.
    memory = (x == 0 and z in (4, 5, 6) and y == 6) or (x == 1 and (y == 6) != (z == 6)) or (x == 2 and z == 6)
    place = f"({index}{_offset(r.byte())})" if index and memory else "(HL)"
    whole = index or "HL"

    def reg(k: int) -> str:
        if k == 6:
            return place
        return index + R[k] if index and k in (4, 5) and not memory else R[k]

    def pair(k: int, names: tuple[str, ...] = RP) -> str:
        return whole if names[k] == "HL" else names[k]

    if x == 1:
        return "HALT" if y == z == 6 else f"LD {reg(y)},{reg(z)}"
    if x == 2:
        return ALU[y] + reg(z)
    if x == 0:
        if z == 0:
            if y < 2:
                return ("NOP", "EX AF,AF'")[y]
            name = ("DJNZ ", "JR ")[y - 2] if y < 4 else f"JR {CC[y - 4]},"
            return name + r.target()
        if z == 1:
            return f"ADD {whole},{pair(p)}" if q else f"LD {pair(p)},{r.nn()}"
        if z == 2:
            if p < 2:
                return f"LD A,({RP[p]})" if q else f"LD ({RP[p]}),A"
            at, target = f"({r.nn()})", whole if p == 2 else "A"
            return f"LD {target},{at}" if q else f"LD {at},{target}"
        if z == 3:
            return f"{'DEC' if q else 'INC'} {pair(p)}"
        if z in (4, 5):
            return f"{'DEC' if z == 5 else 'INC'} {reg(y)}"
        return f"LD {reg(y)},{r.n()}" if z == 6 else ACC[y]
    if z == 0:
        return f"RET {CC[y]}"
    if z == 1:
        return ("RET", "EXX", f"JP ({whole})", f"LD SP,{whole}")[p] if q else f"POP {pair(p, RP2)}"
    if z == 2:
        return f"JP {CC[y]},{r.nn()}"
    if z == 3:
        if y == 0:
            return f"JP {r.nn()}"
        if y in (2, 3):
            port = r.n()
            return f"OUT ({port}),A" if y == 2 else f"IN A,({port})"
        return {4: f"EX (SP),{whole}", 5: "EX DE,HL", 6: "DI", 7: "EI"}[y]
    if z == 4:
        return f"CALL {CC[y]},{r.nn()}"
    if z == 5:
        return f"CALL {r.nn()}" if q else f"PUSH {pair(p, RP2)}"
    return ALU[y] + r.n() if z == 6 else f"RST 0x{8 * y:02X}"


def locate(name: str, data: bytes) -> tuple[int, int | None, bytes]:
    """Origin, entry and code of a file: .com and .cpm at 0100, .bin by its header, else at 0."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext in ("com", "cpm"):
        return 0x100, None, data
    if ext == "bin" and len(data) >= 7 and data[0] == 0xFE:
        start, entry = int.from_bytes(data[1:3], "little"), int.from_bytes(data[5:7], "little")
        return start, entry or None, data[7:]
    return 0, None, data


def rows(code: bytes, origin: int = 0) -> list[tuple[int, bytes, str]]:
    """(address, bytes, text) of every instruction; addresses wrap at 64 K."""
    out, at = [], 0
    while at < len(code):
        n, text = decode(code[at : at + 4] if at + 4 < len(code) else code[at:], origin + at & 0xFFFF)
        out.append((origin + at & 0xFFFF, code[at : at + n], text))
        at += max(n, 1)
    return out


def listing(code: bytes, origin: int = 0, entry: int | None = None) -> str:
    head = [f"; origin 0x{origin:04X}", *([f"; exec   0x{entry:04X}"] if entry is not None else [])]
    body = [f"{a:04X}  {''.join(f'{b:02X} ' for b in raw):<13}{text}" for a, raw, text in rows(code, origin)]
    return "\n".join(head + body) + "\n"
