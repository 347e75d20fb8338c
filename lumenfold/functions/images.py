"""Numpy kernels on square images and cubic volumes."""

from __future__ import annotations

import numpy as np


def center(image: np.ndarray, forward: bool = True) -> np.ndarray:
    """Circular roll by half the size on every axis."""
    n = image.shape[0]
    by = n // 2 if forward else -(n // 2)
    return np.roll(image, (by,) * image.ndim, axis=tuple(range(image.ndim)))


def grid(n: int) -> np.ndarray:
    """Distance of each pixel from the centre n // 2."""
    y, x = np.mgrid[:n, :n] - n // 2
    return np.hypot(x, y)


def cosine_weights(r: np.ndarray, radius: float, width: float) -> np.ndarray:
    soft = 0.5 + 0.5 * np.cos((r - radius) / max(width, 1e-12) * np.pi)
    return np.where(r < radius, 1.0, np.where(r > radius + width, 0.0, soft))


def soft_mask(image: np.ndarray, radius: float, width: float) -> np.ndarray:
    """The image inside the radius; outside, over a cosine edge, the average of what the mask removes."""
    w = cosine_weights(grid(image.shape[0]), radius, width)
    outside = (1 - w).sum()
    background = ((1 - w) * image).sum() / outside if outside else 0.0
    return w * image + (1 - w) * background


def solvent_flatten(image: np.ndarray, radius: float, width: float) -> np.ndarray:
    """The image or volume inside the radius, over a cosine edge; 0 beyond."""
    at = np.meshgrid(*[np.arange(n) - n // 2 for n in image.shape], indexing="ij")
    return image * cosine_weights(np.sqrt(sum(a * a for a in at)), radius, width)


def noise_mask(image: np.ndarray, radius: float, width: float, sigma2: np.ndarray, seed: int) -> np.ndarray:
    """The image inside the radius; beyond, noise of the given spectrum by shell that the seed fixes."""
    n = image.shape[0]
    shell = np.minimum(np.round(np.hypot(np.fft.fftfreq(n)[:, None], np.fft.rfftfreq(n)) * n).astype(int), len(sigma2) - 1)
    drawn = np.fft.rfft2(np.random.default_rng(seed).normal(size=image.shape)) / n
    noise = np.fft.irfft2(drawn * np.sqrt(2 * sigma2[shell]) * n * n, s=image.shape)
    w = cosine_weights(grid(n), radius, width)
    return w * image + (1 - w) * noise


def window(image: np.ndarray, m: int) -> np.ndarray:
    """The middle of side m of an image or volume."""
    cut = tuple(slice(n // 2 - m // 2, n // 2 - m // 2 + m) for n in image.shape)
    return image[cut]


def low_pass(image: np.ndarray, shell: float, width: float = 2.0) -> np.ndarray:
    """Frequencies below the shell, with a raised cosine edge."""
    n = image.shape[0]
    k = np.hypot(np.fft.fftfreq(n)[:, None], np.fft.rfftfreq(n)) * n
    return np.fft.irfft2(np.fft.rfft2(image) * cosine_weights(k, shell - width / 2, width), s=image.shape)


def fourier_resize(image: np.ndarray, m: int) -> np.ndarray:
    """The image of side m with the same mean, by cutting or padding the spectrum (without its lone Nyquist row)."""
    n = image.shape[0]
    f = np.fft.fftshift(np.fft.fft2(image)) / (n * n)
    out = np.zeros((m, m), complex)
    k = (min(n, m) - 1) // 2
    out[m // 2 - k : m // 2 + k + 1, m // 2 - k : m // 2 + k + 1] = f[n // 2 - k : n // 2 + k + 1, n // 2 - k : n // 2 + k + 1]
    return np.fft.ifft2(np.fft.ifftshift(out)).real * m * m


def translate(image: np.ndarray, dx: float, dy: float, wrap: bool = True, fill: float = 0.0) -> np.ndarray:
    """Bilinear translation in real space."""
    n = image.shape[0]
    y, x = np.mgrid[:n, :n].astype(float)
    return sample(image, y - dy, x - dx, wrap, fill)


def rotate(image: np.ndarray, degrees: float, fill: float = 0.0) -> np.ndarray:
    """Bilinear rotation about the centre n // 2."""
    n = image.shape[0]
    y, x = np.mgrid[:n, :n].astype(float) - n // 2
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return sample(image, -s * x + c * y + n // 2, c * x + s * y + n // 2, False, fill)


def apply_geometry(image: np.ndarray, matrix: np.ndarray, shift: tuple[float, float] = (0.0, 0.0), fill: float = 0.0) -> np.ndarray:
    """The image under an affine map of (x, y) about its middle, bilinear: out(A u + t) = in(u)."""
    n = image.shape[0]
    y, x = np.mgrid[:n, :n].astype(float) - n // 2
    back = np.linalg.inv(np.asarray(matrix, float))
    dx, dy = x - shift[0], y - shift[1]
    return sample(image, back[1, 0] * dx + back[1, 1] * dy + n // 2, back[0, 0] * dx + back[0, 1] * dy + n // 2, False, fill)


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, wrap: bool, fill: float) -> np.ndarray:
    """Bilinear values at (y, x)."""
    n = image.shape[0]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out = np.zeros_like(fy)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < n) & (xx >= 0) & (xx < n)
            value = image[yy % n, xx % n]
            out += wy * wx * (value if wrap else np.where(inside, value, fill))
    return out


def ctf_image(n: int, pixel: float, defocus_u: float, defocus_v: float, angle: float, kilovolts: float = 300.0, cs: float = 2.7, q0: float = 0.1) -> np.ndarray:
    """Contrast transfer on the half-complex grid."""
    v = kilovolts * 1000
    lam = 12.2643247 / np.sqrt(v * (1 + v * 0.978466e-6))
    y, x = np.meshgrid(np.fft.fftfreq(n) / pixel, np.fft.rfftfreq(n) / pixel, indexing="ij")
    u2 = x * x + y * y
    local = -(defocus_u + defocus_v) / 2 - (defocus_u - defocus_v) / 2 * np.cos(2 * (np.arctan2(y, x) - np.radians(angle)))
    argument = np.pi * lam * np.where(u2 == 0, 0.0, local) * u2 + np.pi / 2 * cs * 1e7 * lam**3 * u2 * u2
    return -(np.sqrt(1 - q0 * q0) * np.sin(argument) - q0 * np.cos(argument))


def full_plane(half: np.ndarray, n: int, even: bool) -> np.ndarray:
    """The whole plane, centred, of a half plane: even weights, or transforms whose other half is conjugate."""
    rows, columns = np.arange(n)[:, None], np.arange(n)[None]
    grid = half.reshape(n, n // 2 + 1)
    other = grid[(n - rows) % n, np.minimum(columns, n - columns)]
    full = np.where(columns <= n // 2, grid[rows, np.minimum(columns, n - columns)], other if even else other.conj())
    return np.fft.fftshift(full)


def project(volume: np.ndarray, matrix: np.ndarray, pad: int = 2) -> np.ndarray:
    """Projection of a cube along the third row of the matrix, as a slice through its padded transform."""
    n = volume.shape[0]
    m = n * pad
    big = np.zeros((m,) * 3)
    o = (m - n) // 2
    big[o : o + n, o : o + n, o : o + n] = volume
    f = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(big)))
    ky, kx = np.mgrid[:n, :n] - n // 2
    at = pad * (kx[..., None] * matrix[0] + ky[..., None] * matrix[1]) + m // 2  # (x, y, z)
    plane = trilinear(f, at[..., 2], at[..., 1], at[..., 0])
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(plane))).real


def trilinear(f: np.ndarray, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between grid points; 0 outside."""
    out = np.zeros(z.shape, f.dtype)
    z0, y0, x0 = (np.floor(a).astype(int) for a in (z, y, x))
    for dz, wz in ((0, 1 - (z - z0)), (1, z - z0)):
        for dy, wy in ((0, 1 - (y - y0)), (1, y - y0)):
            for dx, wx in ((0, 1 - (x - x0)), (1, x - x0)):
                zz, yy, xx = z0 + dz, y0 + dy, x0 + dx
                ok = (zz >= 0) & (zz < f.shape[0]) & (yy >= 0) & (yy < f.shape[1]) & (xx >= 0) & (xx < f.shape[2])
                out[ok] += (wz * wy * wx)[ok] * f[zz[ok], yy[ok], xx[ok]]
    return out


def scatter(data: np.ndarray, weight: np.ndarray, image: np.ndarray, matrix: np.ndarray, pad: int = 2, ctf: np.ndarray | None = None) -> None:
    """Add the transform of an image to a padded transform and its weights, shared among eight corners."""
    n, m = image.shape[0], data.shape[0]
    plane = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(image)))
    c = np.ones((n, n)) if ctf is None else ctf
    ky, kx = np.mgrid[:n, :n] - n // 2
    keep = np.hypot(kx, ky) < n // 2
    at = (pad * (kx[..., None] * matrix[0] + ky[..., None] * matrix[1]) + m // 2)[keep]
    value, w = (plane * c)[keep], (c * c)[keep]
    base = np.floor(at).astype(int)
    part = at - base
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                share = np.prod(np.where([dx, dy, dz], part, 1 - part), axis=1)
                x, y, z = (base + [dx, dy, dz]).T
                ok = (x >= 0) & (x < m) & (y >= 0) & (y < m) & (z >= 0) & (z < m)
                np.add.at(data, (z[ok], y[ok], x[ok]), (share * value)[ok])
                np.add.at(weight, (z[ok], y[ok], x[ok]), (share * w)[ok])


def reconstruct(data: np.ndarray, weight: np.ndarray, n: int, pad: int = 2, rounds: int = 0) -> np.ndarray:
    """The volume of a padded transform and its weights: division, crop and gridding correction.

    With rounds, the division is by weights that make the blurred density of samples even.
    """
    m = data.shape[0]
    value = data * gridding_weights(weight, rounds) if rounds else np.where(weight > 1e-3, data / np.maximum(weight, 1e-3), 0)
    big = np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(value))).real
    o = (m - n) // 2
    out = big[o : o + n, o : o + n, o : o + n]
    z, y, x = np.mgrid[:n, :n, :n] - n // 2
    r = np.sqrt(z * z + y * y + x * x) / m
    return out / np.maximum(np.sinc(r) ** 2, 1e-3)


def elliptical_low_pass(image: np.ndarray, rx: float, ry: float, width: float = 1.0) -> np.ndarray:
    """A low pass with an elliptic edge, on the image padded to twice its size with the mean of its border."""
    n = image.shape[0]
    border = np.concatenate([image[0], image[-1], image[1:-1, 0], image[1:-1, -1]]).mean()
    big = np.full((2 * n, 2 * n), border)
    big[:n, :n] = image
    ky, kx = np.fft.fftfreq(2 * n)[:, None] * 2 * n, np.fft.rfftfreq(2 * n) * 2 * n
    r = np.sqrt((kx / (2 * rx)) ** 2 + (ky / (2 * ry)) ** 2)
    edge = width / min(rx, ry)
    return np.fft.irfft2(np.fft.rfft2(big) * cosine_weights(r, 1 - edge / 2, edge), s=big.shape)[:n, :n]


def rotate_fourier(image: np.ndarray, degrees: float, pad: int = 2) -> np.ndarray:
    """Rotation about the centre by bilinear values of the padded transform."""
    n = image.shape[0]
    m = n * pad
    o = (m - n) // 2
    big = np.zeros((m, m))
    big[o : o + n, o : o + n] = image
    f = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(big)))
    ky, kx = np.mgrid[:n, :n] - n // 2
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = pad * (-s * kx + c * ky) + m // 2, pad * (c * kx + s * ky) + m // 2
    plane = trilinear(f[None], np.zeros_like(y), y, x)
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(plane))).real


def symmetrise(data: np.ndarray, weight: np.ndarray, operations: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A padded transform and its weights summed over the operations of a group."""
    m = data.shape[0]
    z, y, x = np.mgrid[:m, :m, :m] - m // 2
    at = np.stack([x, y, z], -1).astype(float)
    total, heavy = np.zeros_like(data), np.zeros_like(weight)
    for r in operations:
        to = at @ r.T + m // 2
        total += trilinear(data, to[..., 2], to[..., 1], to[..., 0])
        heavy += trilinear(weight, to[..., 2], to[..., 1], to[..., 0])
    return total, heavy


def hermitian(data: np.ndarray) -> np.ndarray:
    """A centred transform averaged with its mirrored conjugate, as real volumes have."""
    mirrored = np.conj(data[::-1, ::-1, ::-1])
    out = data.copy()
    if data.shape[0] % 2:
        return (data + mirrored) / 2
    inner = data[1:, 1:, 1:]
    out[1:, 1:, 1:] = (inner + np.conj(inner[::-1, ::-1, ::-1])) / 2
    return out


def gridding_weights(weight: np.ndarray, rounds: int = 10, radius: float = 1.9, alpha: float = 15.0) -> np.ndarray:
    """Weights by which a transform is multiplied so that, blurred by the blob, the density of samples is even."""
    from lumenfold.functions.numerics import kaiser_blob

    m = weight.shape[0]
    z, y, x = np.mgrid[:m, :m, :m] - m // 2
    blob = kaiser_blob(np.sqrt(z * z + y * y + x * x), radius, alpha)
    transfer = np.fft.fftn(np.fft.ifftshift(blob / blob.sum()))
    out = np.where(weight > 0, 1.0, 0.0)
    for _ in range(rounds):
        even = np.abs(np.fft.ifftn(np.fft.fftn(out * weight) * transfer))
        out = out / np.maximum(even, 1e-6)
    return out


def wiener_weights(weight: np.ndarray, tau2: np.ndarray, pad: int, fudge: float = 1.0, first: int = 5) -> np.ndarray:
    """Weights with 1 / (pad^3 fudge tau2) of each shell added beyond the first shells; 1 / 1000 of themselves without signal."""
    m = weight.shape[0]
    z, y, x = np.mgrid[:m, :m, :m] - m // 2
    shell = np.round(np.sqrt(z * z + y * y + x * x) / pad).astype(int)
    inside = shell < len(tau2)
    t = np.where(inside, tau2[np.minimum(shell, len(tau2) - 1)], 0.0)
    more = np.where(t > 0, 1 / np.maximum(pad**3 * fudge * t, 1e-300), 1 / np.maximum(0.001 * weight, 1e-300))
    return np.where(inside & (shell >= first) & (weight > 0), weight + more, weight)


def spline_zoom(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Cubic interpolation through the samples that maps corners to corners, with natural ends."""
    for axis, n in enumerate(shape):
        a = np.moveaxis(a, axis, 0)
        m = len(a)
        if m < 3 or n < 2:
            return np.moveaxis(a, 0, axis)
        # second derivatives of a natural spline
        system = np.diag(np.full(m, 4.0)) + np.diag(np.ones(m - 1), 1) + np.diag(np.ones(m - 1), -1)
        system[0], system[-1] = np.eye(m)[0], np.eye(m)[-1]
        right = np.zeros_like(a, float)
        right[1:-1] = 6 * (a[2:] - 2 * a[1:-1] + a[:-2])
        curve = np.linalg.solve(system, right.reshape(m, -1)).reshape(a.shape)
        at = np.linspace(0, m - 1, n)
        low = np.minimum(at.astype(int), m - 2)
        t = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        a = (1 - t) * a[low] + t * a[low + 1] + ((1 - t) ** 3 - (1 - t)) * curve[low] / 6 + (t**3 - t) * curve[low + 1] / 6
        a = np.moveaxis(a, 0, axis)
    return a
