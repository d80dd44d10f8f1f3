"""What names of elements say of a page, and what they don't."""

import pytest

from loomtext.llm import wrappers

PAGE = "<html><body><nav>Menu</nav><header><h1>Site</h1></header>%s<footer>Foot</footer></body></html>"
BODY = "<h1>Title</h1><p>First para.</p><p>Second para.</p>"
WHOLE = "Title\n\nFirst para.\n\nSecond para."


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<section class="social-science">{BODY}</section>', WHOLE),
        (f'<div class="related-work">{BODY}</div>', WHOLE),
        (f'<div class="commentary" id="legal-theory">{BODY}</div>', WHOLE),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>First para.</p></article>', "Title\n\nFirst para."),
        ('<article><header><h1>Title</h1><p>by me</p></header><p>First para.</p></article>', "Title\n\nFirst para."),
        ('<article><div class="article-header"><p>Share</p><h2>Title</h2></div><p>First para.</p></article>', "Title\n\nFirst para."),
        ('<article><p>Text.</p><div class="talkback"><p>Reader says</p></div></article>', "Text."),
        ('<article><p>Text.</p><div class="ad-box">Buy</div><div class="comments-list">c</div><div class="Social share">s</div><aside>a</aside></article>', "Text."),
        ('<div class="content"><p>Text.</p></div><div class="site-header"><h2>Not this</h2></div><div class="sidebar left">x</div>', "Text."),
    ],
)
def test_names_mark_only_what_they_name_whole(html, want):
    assert wrappers.extract(PAGE % html, None) == want
    own = lambda x, k: x.replace("para", f"para{k}").replace("Text", f"Text{k}")
    pages = [PAGE % own(html, k) for k in range(6)]
    host = wrappers.infer(pages)
    assert [wrappers.extract(p, host) for p in pages] == [own(want, k) for k in range(6)]
