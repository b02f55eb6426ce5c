"""Line dedup that knows where a line stands first, and makes sets of many lines at once."""

import numpy as np

from tessera.llm import lines


def test_places_sort_as_number_and_hash():
    number, th = np.array([0, 0, 1, 1, 70_000]), np.array([-(1 << 31), (1 << 31) - 1, -5, 3, -1], np.int32)
    place = lines._place(number, th)
    assert (np.diff(place) > 0).all() and (place >> 32 == number).all() and ((place & 0xFFFFFFFF) - (1 << 31) == th).all()


def test_a_combined_line_keeps_its_first_place():
    """The place is of the smallest document, and the smallest one there, whatever the order of the rows."""
    rows = np.zeros(6, lines._RECORD)
    rows["h1"], rows["h2"], rows["c"] = [5, 5, 5, 5, 6, 6], [1, 1, 1, 2, 1, 1], 1
    rows["doc"], rows["at"] = [9, 2, 2, 1, -4, 8], [0, 30, 20, 7, 50, 10]
    want = [(5, 1, 3, 2, 20), (5, 2, 1, 1, 7), (6, 1, 2, -4, 50)]
    for order in (np.arange(6), np.arange(6)[::-1], np.array([3, 5, 1, 0, 4, 2])):
        assert lines._combined(rows[order])[["h1", "h2", "c", "doc", "at"]].tolist() == want
    assert lines._combined(lines._combined(rows))["at"].tolist() == [20, 7, 50]


def test_sets_of_many_lines_are_those_of_each():
    """Runs are found for all lines at once: no entry moves to a neighbour, also beside empty, short and repetitive lines."""
    texts = ["", "abc", "aaaaaaaaaa", "abcdeabcde", "", "bcdea", "x", "aaaaaaaaaaa", "日本語日本語日本", "abcd", ""]
    for sets in (lines.numbered_sets, lines.hashed_sets):
        every = sets(texts)
        assert len(every) == len(texts) and all((np.diff(x.astype(object)) > 0).all() for x in every)
        assert [len(x) for x, t in zip(every, texts) if t] == [len(lines.character_shingles(t)) for t in texts if t]
        assert np.array_equal(lines._sets_in(np.array([3, 1, 3, 9, 2, 2], np.int64), ["abcdefg", "abcdef"][:1], None)[0], [1, 3])
