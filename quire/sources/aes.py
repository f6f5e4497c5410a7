"""AES in CBC mode over bytes; tables are made from the cipher's rules."""

from __future__ import annotations


def _times(a: int, b: int) -> int:
    """The product in the cipher's field of 256 elements."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> list[int]:
    out = []
    for x in range(256):
        inv = x
        for _ in range(6):  # x ** 254 is the inverse
            inv = _times(_times(inv, inv), x)
        inv = _times(inv, inv)
        s = 0x63
        for k in range(5):
            s ^= (inv << k | inv >> (8 - k)) & 255
        out.append(s)
    return out


SBOX = _sbox()
INVERSE = [SBOX.index(i) for i in range(256)]
MUL = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}
SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
BACK = [SHIFT.index(i) for i in range(16)]


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        rcon = 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [SBOX[x] for x in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                w = [SBOX[x] for x in w]
            words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
        self.keys = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        two, three = MUL[2], MUL[3]
        for r, key in enumerate(self.keys[1:], 1):
            s = [SBOX[s[SHIFT[i]]] for i in range(16)]
            if r < len(self.keys) - 1:
                s = [two[s[c + i]] ^ three[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4)]
            s = [a ^ b for a, b in zip(s, key, strict=True)]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        m9, m11, m13, m14 = MUL[9], MUL[11], MUL[13], MUL[14]
        for r in range(len(self.keys) - 2, -1, -1):
            s = [INVERSE[s[BACK[i]]] ^ self.keys[r][i] for i in range(16)]
            if r:
                s = [m14[s[c + i]] ^ m11[s[c + (i + 1) % 4]] ^ m13[s[c + (i + 2) % 4]] ^ m9[s[c + (i + 3) % 4]] for c in (0, 4, 8, 12) for i in range(4)]
        return bytes(s)

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data), 16):
            iv = self.encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)))
            out += iv
        return bytes(out)

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data) - 15, 16):
            block = data[i : i + 16]
            out += bytes(a ^ b for a, b in zip(self.decrypt_block(block), iv, strict=True))
            iv = block
        return bytes(out)


def unpad(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data
