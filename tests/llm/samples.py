def words(rng, n, size=400):
    return " ".join(f"w{rng.integers(size)}" for _ in range(n))
