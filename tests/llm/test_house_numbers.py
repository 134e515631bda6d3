from orrery.llm.addresses import Parser


def test_long_house_numbers():
    p = Parser([], [])
    num = lambda *x: ((got := p.parse(*x)) and (got["num"], got["street"], got["postal"]))
    assert num("12045 Main Street, Springfield") == ("12045", "main", "")
    assert num("1204 Main Street, Springfield") == ("1204", "main", "")
    assert num("12045 Main Street, Springfield 79180") == ("12045", "main", "79180")
    assert num("1204 Maple, Springfield 79180") == ("1204", "maple", "79180")
    assert num("12045 Main Street", "Springfield", "", None) == ("12045", "main", "")
    assert num("1204 Maple", "Springfield", "79180", None) == ("1204", "maple", "79180")


def test_postal_codes_stay_codes():
    p = Parser([], [])
    assert p.parse("79180 Springfield, Main Street 12")["postal"] == "79180"
    assert p.parse("6344, 5 Oaken Square, Freeland")["postal"] == "6344"
    assert p.parse("PO Box 1234, Springfield 79180") is None
