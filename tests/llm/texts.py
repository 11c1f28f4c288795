"""Small invented corpora with copies, near copies, shared passages and odd rows."""
import random

#: Rows that every operator must take: null, empty, blank, wordless and very long texts, extra clashing columns.
ODD = [None, "", "  \n\t ", "***", "one", "É è ü ß", "x " * 30000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, id long, window string"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed, groups=4, copies=6, size=60):
    """Documents in groups: a base, copies of it, and copies with a few words changed."""
    rnd, out = random.Random(seed), []
    for _ in range(groups):
        base = words(rnd, size)
        for c in range(copies):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
                own[rnd.randrange(size)] = f"new{rnd.randrange(10**6)}"
            out.append(" ".join(own) if c % 2 else " ".join(own).upper())
    out += [" ".join(words(rnd, rnd.randrange(1, 9))) for _ in range(6)]
    return out


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 1, 7, 7, 7, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups_of(links, ids):
    """Smallest id reachable over links, for every id."""
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {i: root(i) for i in ids}
