import numpy as np
import pytest

from tessella.functions import linalg as la
from tessella.operators import integrate as ig
from tessella.operators import selection
from tessella.operators.federated import forward, local_steps, start
from tessella.operators.models import softmax_fit
from tessella.sources.synthetic import random_images, related_images


@pytest.fixture
def images():
    return random_images(3, 200, 6, seed=4)


def aligned(a, b):
    return a * np.sign((a * b).sum(axis=0))


def test_generalised_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(8, 8)), rng.normal(size=(20, 8))
    a, b = a + a.T, b.T @ b
    w, v = la.generalised(a, b)
    assert np.allclose(a @ v, b @ v * w) and np.allclose(v.T @ b @ v, np.eye(8)) and (np.diff(w) >= 0).all()


def test_block_eigen_is_the_shared_basis(images):
    s = list(images.values())
    w, maps = la.block_eigen(s, 4)
    singular, other, _ = la.shared_basis(s, 4)
    assert np.allclose(w, 2 * 3 - 2 * singular**2, atol=1e-5)
    for g, h in zip(maps, other):
        assert np.allclose(aligned(g, h) / np.linalg.norm(g, axis=0), h / np.linalg.norm(h, axis=0), atol=1e-4)


def test_targetvec_is_least_of_the_summed_projections(images):
    maps = ig.solve(images, 4, "targetvec")
    c = 3 * np.eye(200) - sum(s @ np.linalg.pinv(s) for s in images.values())
    w, z = la.smallest(c, 4)
    assert np.allclose(w, maps.values, atol=1e-8) and np.allclose(aligned(maps.target, z), z, atol=1e-6)


def test_rotated_images_align_exactly():
    images = related_images(4, 60, 5, seed=2)
    for method in ("Imakura", "targetvec", "QR_SVD", "GEP", "ODC"):
        maps = ig.solve(images, 5, method)
        z = [images[i] @ maps.linear[i] for i in images]
        assert max(np.abs(x - z[0]).max() for x in z) < 1e-4, method


def test_nonlinear_solutions_reproduce_their_target(images):
    for method in ("nonlinear", "nonlinear_linear"):
        maps = ig.solve(images, 3, method, penalty=1e-6)
        z = [maps.transform(i, s)(s) for i, s in images.items()]
        assert max(np.abs(x - maps.target).max() for x in z) < 0.05, method
    start_at = {i: 1 / 6 for i in images}
    tuned = ig.tuned_widths(images, 3, start_at)
    assert set(tuned) == set(images) and all(g > 0 for g in tuned.values())


def test_kernel_ridge_with_linear_part_leaves_lines_alone(images):
    s = images[0]
    hat, fitted = la.smoother(s, 0.1, 5.0, with_linear=True)
    z = s @ np.ones((6, 1))
    assert np.allclose(hat @ z, z, atol=1e-6) and np.allclose(fitted(z)(s + 1), (s + 1) @ np.ones((6, 1)), atol=1e-6)


def test_reductions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 8))
    mean, v = la.pca(x, 7)
    assert v.shape == (8, 7) and not v[:, 5:].any() and np.allclose((((x - mean) @ v) ** 2).sum(), ((x - mean) ** 2).sum())
    x = rng.normal(size=(40, 5))
    score = la.kernel_pca(x, 40, 0.2)(x)
    gram = la.rbf(x, x, 0.2)
    h = np.eye(40) - 1 / 40
    assert np.allclose(score @ score.T, h @ gram @ h, atol=1e-7)
    assert la.locality_projection(x, 3, 8).shape == (5, 3)
    y = (x[:, :1] > 0).astype(float)
    first = la.kernel_cca(x, np.hstack([y, 1 - y]), 1, 0.2)(x)[:, 0]
    assert abs(np.corrcoef(first, y[:, 0])[0, 1]) > 0.8


def test_correlated_directions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5))
    y = (x[:, :1] + 0.3 * rng.normal(size=(80, 1)) > 0).astype(float)
    both = np.hstack([y, 1 - y])
    r, a = la.cca(x, both, 3)
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    fitted = xc @ np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert a.shape == (5, 3) and not a[:, 2].any() and np.isclose(r[0], np.corrcoef(fitted[:, 0], y[:, 0])[0, 1], atol=1e-4)
    gamma = la.median_width(x)
    h, n = np.eye(80) - 1 / 80, np.eye(80)
    kx, ky = h @ la.rbf(x, x, gamma) @ h, h @ (both @ both.T) @ h
    root = lambda m: (lambda w, v: (v / np.sqrt(w)) @ v.T)(*np.linalg.eigh(m))
    u, s, _ = np.linalg.svd(root(kx + 1e-3 * n) @ kx @ ky @ root(ky + 1e-3 * n))
    values, scores = la.whitened_kernel_cca(x, both, 2, gamma)
    expected = kx @ root(kx + 1e-3 * n) @ u[:, :1]
    assert np.isclose(values[0], s[0]) and np.allclose(aligned(scores(x)[:, :1], expected), expected, atol=1e-6)
    m = np.linalg.inv(kx + 1e-3 * n) @ ky @ np.linalg.inv(ky + 1e-3 * n) @ kx
    lead = np.linalg.eigh((m + m.T) / 2)[1][:, -1:]
    assert np.allclose(aligned(la.symmetric_kernel_cca(x, both, 1, gamma)(x), kx @ lead), kx @ lead, atol=1e-6)


def test_weighted_maps_errors_and_widths(images):
    plain, weighted = ig.solve(images, 4, "GEP"), ig.solve(images, 4, "GEP_weighted_maps")
    w = la.eigen_weights(plain.values)
    assert all(np.allclose(plain.linear[i] * w, weighted.linear[i]) for i in images)
    related = related_images(3, 60, 5, seed=2)
    linear, kernel = la.alignment_errors(list(related.values()), 4)
    assert linear < 1e-18 and 0 < kernel < 1e-3
    wide = {i: 50.0 for i in related}
    assert all(g < 50 for g in ig.tuned_widths(related, 3, wide).values())


def test_selection_finds_the_columns_that_matter():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 9))
    y = (x[:, 4] + 0.5 * x[:, 7] > 0).astype(int)
    unit = x / np.linalg.norm(x, axis=0)
    assert selection.forward(unit, y, 2) == [4, 7] and selection.backward(unit[:, [0, 4, 1, 7, 2, 3]], y, 2) == [1, 3]
    assert selection.choose(unit, y, 4, "forward", 0.5) == [0, 1, 4, 7] and selection.choose(unit, y, 4, "backward", 0.0) == [0, 1, 2, 3]
    assert selection.backward(unit, y, 2) != [4, 7]  # 7 is beyond three candidates for each direction
    with pytest.raises(ValueError, match="unknown selection"):
        selection.choose(unit, y, 2, "sideways", 0.5)


def test_selection_in_the_integration(images):
    y = (images[0][:, 0] > np.median(images[0][:, 0])).astype(int)
    for method in ("targetvec", "nonlinear"):
        plain = ig.solve(images, 4, method)
        assert np.allclose(np.abs(ig.solve(images, 4, method, anchor_target=y, selection_ratio=0.0).target), np.abs(plain.target), atol=1e-8)
        for rule in ("forward", "backward"):
            chosen = ig.solve(images, 4, method, anchor_target=y, selection=rule, selection_ratio=0.5)
            assert np.allclose(np.abs(chosen.target[:, :2]), np.abs(plain.target[:, :2]), atol=1e-8) and chosen.target.shape == (200, 4) and len(chosen.values) == 4
            assert np.allclose(chosen.target.T @ chosen.target, np.eye(4), atol=1e-8)
    with pytest.raises(ValueError, match="selection"):
        ig.solve(images, 4, "ODC", anchor_target=y)


def test_power_iteration_and_inversion():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 6))
    assert abs(la.top_singular(a, 2000, 1e-12)[0] - np.linalg.norm(a, 2)) < 1e-6
    f = rng.normal(size=(6, 6))
    assert np.allclose(la.linear_inversion(a @ f, a, a[:4] @ f), a[:4])


def test_weights_and_constant_columns():
    assert np.allclose(la.eigen_weights(np.array([1.0, 2.0, 3.0])), np.exp([0, -0.5, -1]))
    assert np.allclose(la.eigen_weights(np.ones(3)), 1)
    assert np.isfinite(la.self_tuning(np.ones((10, 3))))


def test_softmax_and_local_steps_learn():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0).astype(int)
    w, b = softmax_fit(x, y, 4)
    assert ((x @ w + b).argmax(axis=1) == y).mean() > 0.9
    shape = (5, 16, 4)
    flat = start(*shape, 0)
    loss = lambda f: -np.log(forward(f, x, shape)[1][np.arange(400), y]).mean()
    assert loss(local_steps(flat, x, y, shape, 20, 0.1)) < loss(flat)


def test_locality_directions_lie_in_the_span_of_the_rows():
    rng = np.random.default_rng(4)
    x = np.zeros((40, 64))
    x[:, 44:] = rng.normal(size=(40, 20))
    x[1::4] = x[::4] + 0.01 * rng.normal(size=(10, 64)) * (x[:1] != 0)  # near pairs
    v = la.locality_projection(x, 12, 8)
    assert np.linalg.matrix_rank(x @ v, tol=1e-6 * np.linalg.norm(x @ v, 2)) == 12 and np.abs(v[:44]).max() < 1e-9 * np.abs(v).max()


def test_locality_directions_are_solved_or_an_error(monkeypatch):
    rng = np.random.default_rng(8)
    x = 1e4 * rng.normal(size=(40, 6))
    x[1:6:2] = x[:6:2] + 0.02 * np.sign(rng.normal(size=(3, 1))) * np.eye(6)[0]  # three near pairs along one axis, which leave directions to the ridge
    v = la.locality_projection(x, 6, 1)
    w = np.exp(-((x[:6:2] - x[1:6:2]) ** 2).sum(axis=1) / 0.01)
    image = x[:6] @ v
    sizes = np.sqrt(np.repeat(w, 2))[:, None] * image
    apart = np.sqrt(w)[:, None] * (image[::2] - image[1::2])
    assert np.abs(sizes.T @ sizes + 1e-9 * v.T @ v - np.eye(6)).max() < 1e-3
    values = (apart * apart).sum(axis=0)
    assert np.abs(apart.T @ apart - np.diag(values)).max() < 1e-3 and (np.diff(values) > -1e-3).all()

    def failing(a):
        raise np.linalg.LinAlgError("no eigenvalues")

    monkeypatch.setattr(np.linalg, "eigh", failing)
    with pytest.raises(np.linalg.LinAlgError):
        la.locality_projection(x, 6, 1)


def test_an_affine_image_is_told_by_its_spread(spark):
    from tessella.operators import reduce as rd

    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 3))
    anchors = spark.createDataFrame([("anchor", i, r.tolist()) for i, r in enumerate(x)], "anchor_set string, anchor_id long, features array<double>")
    images = {0: 1 + 1e-9 * x @ rng.normal(size=(3, 2)), 1: 1 + 1e-9 * x[:, :2] ** 2}
    rows = [(i, part, at, 0, r.tolist(), None) for i, image in images.items() for part in ("train", "test", "anchor") for at, r in enumerate(image)]
    found = rd.identities(spark.createDataFrame(rows, rd.SCHEMA), anchors).orderBy("institution").collect()
    assert [r["affine"] for r in found] == [True, False]
