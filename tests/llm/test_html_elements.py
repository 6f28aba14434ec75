"""Elements inside an article whose text stays or goes."""

from factloom.llm import html as pages


def test_embedded_elements_keep_the_article():
    tree = pages.train()

    def text(inside: str) -> str:
        return pages.main_text(f"<body><article><p>Before it {inside} stands all of the later text.</p><p>And more of it.</p></article></body>", tree)

    rest = "Before it stands all of the later text.\nAnd more of it."
    for gone in ('<svg width="1"/>', '<svg a="x>y"/>', "<iframe src='u'/>", "<object/>", "<math/>", "<noscript>", "<svg>", "<template>", "<svg><text>no</text></svg>", "<iframe>no</iframe>", "<noscript>no</noscript>"):
        assert text(gone) == rest, gone
    assert text('<svg/> one <svg><text>no</text></svg>') == rest.replace("it stands", "it one stands")
    assert text("<math><mi>x</mi></math>") == rest.replace("it stands", "it x stands")
    assert text("<object data='u'>instead</object>") == rest.replace("it stands", "it instead stands")
    assert text("<script>no") == "Before it"
